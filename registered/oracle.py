"""The registered queries in DuckDB SQL, written independently of the package."""

_BLANKS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _nbytes(text: str) -> str:
    return f"strlen(regexp_replace({text}, '^{_BLANKS}+|{_BLANKS}+$', '', 'g'))"


def _is_blank(text: str) -> str:
    return f"regexp_full_match({text}, '{_BLANKS}*')"


_ENTRIES = """
entries AS (
  SELECT *, concat(doc_id, CASE WHEN is_title THEN '-title' ELSE '' END) AS name
  FROM (SELECT doc_id, source, lang, n_chars, false AS is_title, text AS body FROM documents
        UNION ALL
        SELECT doc_id, source, lang, n_chars, true, concat('Document ', source, ' ', lang) FROM documents))
"""

_CANDIDATES = f"""
{_ENTRIES},
candidates AS (
  SELECT doc_id, name,
         concat('/corpus/', source, '/', lang, '/', name, '.pdf') AS file_path,
         sha256(body) AS file_hash,
         n_chars,
         CASE WHEN doc_id % 7 <> 3 THEN body END AS direct_text,
         CASE WHEN doc_id % 7 = 3 THEN 'Failed to load PDF document' END AS direct_error,
         CAST(1 + doc_id % 5 AS INT) AS direct_pages,
         CASE WHEN is_title AND doc_id % 4 = 0
              THEN concat('Document ', doc_id, ' of the corpus, from ', source, ', written in language ', lang)
              WHEN is_title AND doc_id % 2 = 0 THEN source END AS alt_text,
         CASE WHEN NOT (is_title AND doc_id % 3 = 0) THEN concat('OCR ', body) END AS ocr_text,
         CASE WHEN is_title AND doc_id % 3 = 0 THEN 'No images generated from PDF' END AS ocr_error,
         CAST(1 + doc_id % 4 AS INT) AS ocr_pages
  FROM entries)
"""

_CHOICE = f"""
{_CANDIDATES},
measured AS (SELECT *, {_nbytes("direct_text")} AS dl, {_nbytes("alt_text")} AS al FROM candidates),
chosen AS (
  SELECT *,
         CASE WHEN direct_text IS NULL THEN NULL WHEN dl < 50 AND al > dl THEN alt_text ELSE direct_text END AS dt,
         CASE WHEN direct_text IS NULL THEN NULL WHEN dl < 50 AND al > dl THEN al ELSE dl END AS n
  FROM measured)
"""


def _outcome(method: str, message: str) -> str:
    return f"""
{_CHOICE},
decided AS (SELECT *, CASE {method} ELSE 'error' END AS extraction_method FROM chosen),
outcome AS (
  SELECT doc_id, name, file_path, file_hash, n_chars AS file_size, extraction_method,
         CASE extraction_method WHEN 'ocr' THEN ocr_text WHEN 'error' THEN '' ELSE dt END AS extracted_text,
         CASE extraction_method WHEN 'ocr' THEN ocr_pages WHEN 'error' THEN 0 ELSE direct_pages END AS page_count,
         CAST(n_chars AS DOUBLE) / 1024 AS processing_time_seconds,
         TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 37) * INTERVAL '1' MINUTE AS timestamp,
         extraction_method <> 'error' AS success,
         CASE WHEN extraction_method = 'error' THEN {message} END AS error_message
  FROM decided)
"""


_DEFAULT = _outcome(
    """WHEN dt IS NOT NULL AND n > 50 THEN 'direct'
       WHEN ocr_text IS NOT NULL THEN 'ocr'
       WHEN dt IS NOT NULL THEN 'direct_partial'""",
    "concat('Direct: ', direct_error, ', OCR: ', ocr_error)",
)
_TEXT_ONLY = _outcome(
    "WHEN dt IS NOT NULL AND n > 50 THEN 'direct' WHEN dt IS NOT NULL THEN 'direct_partial'",
    "concat('Direct: ', direct_error, ', OCR: OCR disabled (text-only mode)')",
)
_OCR_ONLY = _outcome("WHEN ocr_text IS NOT NULL THEN 'ocr'", "concat('OCR failed: ', ocr_error)")
_BOTH_FLAGS = _outcome("WHEN false THEN 'ocr'", "'OCR failed: OCR disabled (text-only mode)'")

_OUTCOME = "file_path, extraction_method, extracted_text, page_count, success, error_message"

_STAMP = "strftime(timestamp, '%Y-%m-%d %H:%M:%S')"

_VERSIONS = f"""
{_DEFAULT},
numbered AS (SELECT * REPLACE (concat('/corpus/', name, '.pdf') AS file_path) FROM outcome),
versions AS (
  SELECT * REPLACE (CASE WHEN doc_id % 50 = 8 THEN NULL ELSE file_hash END AS file_hash), 1 AS batch_id FROM numbered
  UNION ALL
  SELECT * REPLACE (
           CASE WHEN doc_id % 50 = 8 THEN NULL
                WHEN doc_id % 4 = 0 THEN file_hash ELSE sha256(file_hash || 'v2') END AS file_hash,
           concat('v2 ', extracted_text) AS extracted_text,
           timestamp + INTERVAL '1' DAY AS timestamp),
         2 AS batch_id
  FROM numbered WHERE doc_id % 4 IN (0, 1)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file_path, file_hash ORDER BY batch_id DESC) AS place FROM versions),
current_rows AS (SELECT * FROM ranked WHERE file_hash IS NULL OR place = 1)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _search(rows: str, source: str, query: str, limit: int) -> str:
    def fold(text: str) -> str:
        return f"translate({text}, '{_UPPER}', '{_LOWER}')"

    return f"""
WITH {rows}
SELECT file_path, extraction_method, substr(extracted_text, 1, 200) AS preview, {_STAMP} AS timestamp
FROM {source}
WHERE success AND {fold("extracted_text")} LIKE {fold(f"'%{query}%'")}
ORDER BY {source}.timestamp DESC, file_path, file_hash LIMIT {limit}"""


def _stats(rows: str, source: str) -> str:
    return f"""
WITH {rows}
SELECT count(*) AS total,
       count(*) FILTER (WHERE success) AS successful,
       count(*) - count(*) FILTER (WHERE success) AS failed,
       count(*) FILTER (WHERE success) * 100.0::DOUBLE / nullif(count(*), 0) AS success_rate,
       coalesce(avg(processing_time_seconds) FILTER (WHERE success), 0.0::DOUBLE) AS avg_processing_time
FROM {source}"""


def _listing(condition: str, rows: str = _DEFAULT, source: str = "outcome") -> str:
    return f"""
WITH {rows}
SELECT file_path, file_hash, file_size, extraction_method, page_count, processing_time_seconds,
       {_STAMP} AS timestamp, success, error_message
FROM {source} WHERE {condition}"""


def _json(text: str) -> str:
    return f"""
WITH {_DEFAULT}
SELECT file_path, file_hash, file_size, extraction_method, {text} page_count, processing_time_seconds,
       strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, success, error_message
FROM outcome"""


_BLOCKS = f"""
WITH {_DEFAULT}
SELECT file_path, file_hash,
       'FILE: ' || file_path || chr(10) || 'METHOD: ' || extraction_method || chr(10)
       || 'SUCCESS: ' || CASE WHEN success THEN 'true' ELSE 'false' END || chr(10)
       || 'TIMESTAMP: ' || {_STAMP} || chr(10) || repeat('=', 80) || chr(10)
       || CASE WHEN success AND extracted_text <> '' THEN extracted_text
               WHEN error_message IS NOT NULL THEN 'ERROR: ' || error_message || chr(10)
               ELSE '' END
       || chr(10) || repeat('=', 80) || chr(10) || chr(10) AS block
FROM outcome"""

_PAGES = """
pages_of AS (
  SELECT conv_id AS file_id, CAST(turn + 1 AS INT) AS page_num,
         CASE WHEN (conv_id + turn) % 6 = 5 THEN '  ' ELSE text END AS page_text
  FROM conversations)
"""


def _assembly(label_end: str) -> str:
    return f"""
WITH {_PAGES}
SELECT file_id,
       coalesce(string_agg('--- Page ' || page_num || '{label_end} ---' || chr(10) || page_text || chr(10) || chr(10),
                           '' ORDER BY page_num) FILTER (WHERE NOT {_is_blank("page_text")}), '') AS text,
       CAST(count(*) AS INT) AS page_count
FROM pages_of GROUP BY file_id"""


_FILES = f"""
{_ENTRIES},
files AS (
  SELECT *, CASE WHEN is_broken THEN '\\xFF'::BLOB ELSE ''::BLOB END || encode(body) AS content
  FROM (SELECT concat('/corpus/', source, '/', lang, '/', name, '.pdf') AS path, 1700000000 + doc_id AS modified,
               doc_id % 7 = 3 AS is_broken, replace(body, chr(10), chr(12)) AS body
        FROM entries))
"""

_FAST_HASH = """
sha256(unhex(printf('%016x', octet_length(content))) || unhex(printf('%016x', modified))
       || array_slice(content, 1, 1024)
       || CASE WHEN octet_length(content) > 1024
               THEN array_slice(content, greatest(1025, octet_length(content) - 1023), octet_length(content))
               ELSE ''::BLOB END)
"""


def _joined(pages: str, label_end: str) -> str:
    """Labelled text of a list of pages, NULL and blank ones left out."""
    return f"""
array_to_string(list_filter(list_transform({pages}, lambda page, i:
    CASE WHEN page IS NOT NULL AND NOT {_is_blank("page")}
         THEN '--- Page ' || i || '{label_end} ---' || chr(10) || page || chr(10) || chr(10) END),
    lambda block: block IS NOT NULL), '')"""


def _extract(method: str, message: str, alternative: bool = True, files: str = "files", file_hash: str = _FAST_HASH) -> str:
    alt_text = "CASE WHEN octet_length(content) % 3 <> 0 THEN repeat(replace(body, chr(12), ' '), 3) END"
    return f"""
WITH {_FILES},
decoded AS (
  SELECT path AS file_path, {file_hash} AS file_hash, CAST(octet_length(content) AS BIGINT) AS file_size, is_broken,
         CASE WHEN NOT is_broken THEN {_joined("string_split(body, chr(12))", "")} END AS direct_text,
         CAST(len(string_split(body, chr(12))) AS INT) AS pages,
         {alt_text if alternative else "NULL"} AS alt_text,
         CASE WHEN octet_length(content) % 4 <> 0 THEN {_joined(
             "list_transform(string_split(body, chr(12)), "
             "lambda p: CASE WHEN length(p) % 5 <> 0 THEN 'OCR ' || p END)", " (OCR)")} END AS ocr_text
  FROM {files}),
measured AS (SELECT *, {_nbytes("direct_text")} AS dl, {_nbytes("alt_text")} AS al FROM decoded),
chosen AS (
  SELECT *, CASE WHEN direct_text IS NULL THEN NULL WHEN dl < 50 AND al > dl THEN alt_text ELSE direct_text END AS dt,
            CASE WHEN direct_text IS NULL THEN NULL WHEN dl < 50 AND al > dl THEN al ELSE dl END AS n
  FROM measured),
decided AS (SELECT *, CASE {method} ELSE 'error' END AS extraction_method FROM chosen)
SELECT file_path, file_hash, file_size, extraction_method,
       CASE extraction_method WHEN 'ocr' THEN ocr_text WHEN 'error' THEN '' ELSE dt END AS extracted_text,
       CASE WHEN extraction_method = 'error' THEN 0 ELSE pages END AS page_count,
       extraction_method <> 'error' AS success,
       CASE WHEN extraction_method = 'error' THEN {message} END AS error_message
FROM decided"""


_TREE = """
sizes AS (SELECT conv_id, CAST(sum(strlen(text)) AS BIGINT) AS size FROM conversations GROUP BY conv_id),
files AS (
  SELECT CASE conv_id % 6 WHEN 0 THEN concat('a/b c/', conv_id, '.pdf') WHEN 1 THEN concat('_b/.c/', conv_id, '.pdf')
                          WHEN 2 THEN concat('.', conv_id, '.pdf') WHEN 3 THEN concat('_', conv_id, '.pdf')
                          WHEN 4 THEN concat('k=v/empty %20+', conv_id, '.pdf') ELSE concat('d/', conv_id, '/x.y.pdf') END AS path,
         CASE WHEN conv_id % 6 = 4 THEN 0 ELSE size END AS length, 1600000000 + conv_id AS modified,
         encode(repeat('x', CASE WHEN conv_id % 6 = 4 THEN 0 ELSE size END)) AS content
  FROM sizes)
"""

_ROLES = """
turns AS (SELECT role, coalesce(text, '') AS page, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn, coalesce(text, '')) AS n FROM conversations)
"""


def _roles(label_end: str, page: str, error: str = "") -> str:
    return f"""
WITH {_ROLES}
SELECT role, coalesce(string_agg('--- Page ' || n || '{label_end} ---' || chr(10) || {page} || chr(10) || chr(10), '' ORDER BY n)
                      FILTER (WHERE {page} IS NOT NULL AND NOT {_is_blank(page)}), '') AS text,
       CAST(count(*) AS INT) AS page_count{error}
FROM turns GROUP BY role"""


_ANY_ROUTE = """
WHEN dt IS NOT NULL AND n > 50 THEN 'direct'
WHEN ocr_text IS NOT NULL THEN 'ocr'
WHEN dt IS NOT NULL THEN 'direct_partial'
"""
_BOTH_FAILED = "'Direct: Failed to load PDF document, OCR: No images generated from PDF'"

_STORED = f"""
{_VERSIONS},
stored AS (SELECT * REPLACE (make_timestamp(2024, 1, batch_id, 0, 0, 0.0) AS timestamp) FROM current_rows)
"""

_ROW = f"""
file_path, file_hash, file_size, extraction_method, extracted_text, page_count, processing_time_seconds,
{_STAMP} AS timestamp, success, error_message, CAST(batch_id AS BIGINT) AS batch_id"""

_HELD = """
held AS (SELECT file_path, file_hash FROM versions WHERE batch_id = 1),
listing AS (SELECT file_path, file_hash FROM versions WHERE batch_id = 2)
"""

_IS_HELD = "EXISTS (SELECT 1 FROM held h WHERE h.file_path = l.file_path AND h.file_hash = l.file_hash)"

ORACLE = {
    "search_text": _search(_DEFAULT, "outcome", "the on", 10),
    "search_wildcard": _search(_DEFAULT, "outcome", "th_ ", 25),
    "search_two_parts": _search(_DEFAULT, "outcome", "ocr%THE_", 25),
    "search_ascii_case": _search(_DEFAULT, "outcome", "É", 1000),
    "search_everything": _search(_DEFAULT, "outcome", "", 1000),
    "search_versions": _search(_VERSIONS, "current_rows", "the on", 100),
    "ledger_stats": _stats(_DEFAULT, "outcome"),
    "ledger_stats_versions": _stats(_VERSIONS, "current_rows"),
    "ledger_stats_empty": _stats(_DEFAULT, "outcome WHERE file_path < '/corpus/'"),
    "list_files": _listing("success"),
    "list_method": _listing("success AND extraction_method = 'direct_partial'"),
    "list_with_failed": _listing("true"),
    "export_json_rows": _json(""),
    "export_json_rows_text": _json("extracted_text,"),
    "export_text_blocks": _BLOCKS,
    "page_assembly": _assembly(""),
    "page_assembly_ocr": _assembly(" (OCR)"),
    "page_count": f"WITH {_PAGES} SELECT file_id, CAST(count(*) AS INT) AS page_count FROM pages_of GROUP BY file_id",
    "blank_pages": f"WITH {_PAGES} SELECT file_id, page_num FROM pages_of WHERE {_is_blank('page_text')}",
    "text_gate": f"""
SELECT doc_id, CAST({_nbytes("text")} AS INT) AS trimmed_bytes, {_nbytes("text")} > 50 AS is_substantial
FROM documents""",
    "text_preview": "SELECT doc_id, substr(text, 1, 200) AS preview FROM documents",
    "alt_text_choice": f"""
WITH {_CHOICE} SELECT name, dt AS chosen_text, CAST(n AS INT) AS chosen_bytes FROM chosen""",
    "cascade_default": f"WITH {_DEFAULT} SELECT {_OUTCOME} FROM outcome",
    "cascade_text_only": f"WITH {_TEXT_ONLY} SELECT {_OUTCOME} FROM outcome",
    "cascade_ocr_only": f"WITH {_OCR_ONLY} SELECT {_OUTCOME} FROM outcome",
    "cascade_both_flags": f"WITH {_BOTH_FLAGS} SELECT {_OUTCOME} FROM outcome",
    "full_fingerprint": f"WITH {_FILES} SELECT path, sha256(content) AS file_hash FROM files",
    "fast_fingerprint": f"WITH {_FILES} SELECT path, {_FAST_HASH} AS file_hash FROM files",
    "upsert_current": f"""
WITH {_VERSIONS}
SELECT file_path, file_hash, file_size, extraction_method, extracted_text, page_count, processing_time_seconds,
       {_STAMP} AS timestamp, success, error_message, CAST(batch_id AS BIGINT) AS batch_id
FROM current_rows""",
    "upsert_sequence": f"""
WITH {_VERSIONS},
writes AS (
  SELECT v.* REPLACE ('write ' || n || ' ' || extracted_text AS extracted_text), CASE WHEN doc_id % 3 <> n THEN n END AS seq
  FROM versions v, (VALUES (0), (1), (2)) w(n) WHERE batch_id = 2),
written AS (SELECT *, NULL AS seq FROM versions WHERE batch_id = 1 UNION ALL SELECT * FROM writes),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY file_path, file_hash ORDER BY batch_id DESC, seq DESC NULLS LAST) AS last
  FROM written)
SELECT {_ROW} FROM placed WHERE file_hash IS NULL OR last = 1""",
    "already_processed": f"WITH {_VERSIONS}, {_HELD} SELECT * FROM listing l WHERE {_IS_HELD}",
    "pending_files": f"WITH {_VERSIONS}, {_HELD} SELECT * FROM listing l WHERE NOT {_IS_HELD}",
    "run_summary": f"""
WITH {_VERSIONS}
SELECT count(*) AS processed, count(*) FILTER (WHERE success) AS successful,
       count(*) FILTER (WHERE NOT success) AS failed
FROM versions WHERE batch_id = 2""",
    "stored_ledger": f"""
WITH {_VERSIONS}
SELECT file_path, file_hash, file_size, extraction_method, extracted_text, page_count, processing_time_seconds,
       '2024-01-0' || batch_id || ' 00:00:00' AS timestamp, success, error_message
FROM current_rows""",
    "stored_search": _search(_STORED, "stored", "the on", 100),
    "stored_stats": _stats(_STORED, "stored"),
    "stored_list": _listing("true", _STORED, "stored"),
    "run_files": f"""
WITH bodies AS (
  SELECT conv_id, string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn) AS body FROM conversations GROUP BY conv_id),
paged AS (
  SELECT *, CASE WHEN {_is_blank("body")} THEN '' ELSE '--- Page 1 ---' || chr(10) || body || chr(10) || chr(10) END AS shown
  FROM bodies)
SELECT conv_id, sha256(body) AS file_hash, CAST(strlen(body) AS BIGINT) AS file_size,
       CASE WHEN {_nbytes("shown")} > 50 THEN 'direct' ELSE 'direct_partial' END AS extraction_method,
       shown AS extracted_text, CAST(1 AS INT) AS page_count, '2024-01-0' || (1 + conv_id % 2) || ' 00:00:00' AS timestamp
FROM paged""",
    "stored_report": f"""
SELECT unnest(string_split(left(block, length(block) - 1), chr(10))) AS line FROM ({_BLOCKS})
UNION ALL
SELECT unnest(['PDF Text Extraction Results (Rust Edition)', repeat('=', 80), '']) AS line""",
    "stored_json": _json("extracted_text,"),
    "discovered_tree": f"""
WITH {_TREE} SELECT path, length, modified, {_FAST_HASH} AS fast_hash, sha256(content) AS file_hash FROM files""",
    "paged_ocr": _roles(" (OCR)", "CASE WHEN length(page) % 5 <> 0 THEN 'OCR ' || page END"),
    "ranged_text": _roles("", "page", ", CAST(NULL AS VARCHAR) AS error"),
    "page_count_files": f"WITH {_ROLES} SELECT role, CAST(count(*) AS INT) AS page_count FROM turns GROUP BY role",
    "extract_run": _extract(_ANY_ROUTE, _BOTH_FAILED),
    "extract_text_only": _extract(
        "WHEN dt IS NOT NULL AND n > 50 THEN 'direct' WHEN dt IS NOT NULL THEN 'direct_partial'",
        "'Direct: Failed to load PDF document, OCR: OCR disabled (text-only mode)'",
    ),
    "extract_ocr_only": _extract(
        "WHEN ocr_text IS NOT NULL THEN 'ocr'", "'OCR failed: No images generated from PDF'"
    ),
    "extract_pending": _extract(
        _ANY_ROUTE,
        _BOTH_FAILED,
        alternative=False,
        files="files WHERE sha256(content) >= '8'",
        file_hash="sha256(content)",
    ),
}
