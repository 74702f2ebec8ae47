"""Token ids in Parquet files: ids dictionary-encoded, metadata delta-encoded, in document order, read selectively."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textledger.llm.common import ragged, slices
from textledger.llm.token_counts import byte_letters
from textledger.sources.shared import fresh_path, stored

#: Parts of words whose ids a Python worker remembers.
REMEMBERED = 500_000

SCHEMA = "file int, position long, doc_id long, n_tokens long, ids array<int>"

#: Row groups of at most 16 MB, pages of at most 64 KB or 20,000 rows with their indexes, ids by dictionary,
#: all else (version 2 of the format) by delta.
FORMAT = {
    "compression": "zstd",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "20000",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
}


class Encoder:
    """Ids of texts by the tokenizers library.

    Where the tokenizer turns white space into nothing but a border, a batch of texts becomes its different words, and
    these, cut between Latin-1 letters or digits and ASCII marks, where such a tokenizer cuts too, their different parts;
    Arrow finds both. The library sees a part once while it is remembered, and gathering puts the ids of parts into words
    and those of words into texts. Else whole texts are encoded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        self.by_word = borders_at_space(stated)
        self.special = [token["content"] for token in stated["added_tokens"]]
        self.letters = {byte: letter for byte, letter in byte_letters().items() if byte > 0x7F}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lengths, self.ids = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def encode_each(self, texts: list[str]) -> list[list[int]]:
        return [item.ids for item in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, fresh: list[str]) -> None:
        # such a tokenizer changes nothing about these, so their byte letters go straight to its merges
        plain, others = [], []
        for part in fresh:
            (plain if _PLAIN.fullmatch(part) else others).append(part)
        merges = self.tokenizer.model.tokenize
        spelt = (part if part.isascii() else part.encode().decode("latin-1").translate(self.letters) for part in plain)
        ids = [[token.id for token in merges(each)] for each in spelt] + self.encode_each(others)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known.update(zip(chain(plain, others), range(len(self.known), len(self.known) + len(ids))))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum())))

    def cut(self, words: pa.Array) -> pa.Array:
        """The words with spaces at such borders, in lower case; those that hold a special token as they are."""
        spaced = pc.ascii_lower(words)
        for pair in (f"({_WORDLY})({_MARK})", f"({_MARK})({_WORDLY})"):
            spaced = pc.replace_substring_regex(spaced, pair, r"\1 \2")
        for special in self.special:
            held = pc.match_substring(words, special)
            if pc.any(held).as_py():
                spaced = pc.if_else(held, words, spaced)
        return spaced

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text (NULL: none), and all their ids."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_word:
            ids = self.encode_each(texts.to_pylist())
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            return lengths, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))
        words, per_text, codes = _different(texts)
        parts, per_word, part_codes = _different(self.cut(words))
        if len(self.known) > REMEMBERED:
            self.forget()
        names = parts.to_numpy(zero_copy_only=False).tolist()
        self.learn([part for part in names if part not in self.known])
        places = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[part_codes]
        part_ids = self.ids[ragged(self.starts[places], self.lengths[places])]
        word_lengths = _sums(self.lengths[places], per_word)
        lengths = word_lengths[codes]
        return _sums(lengths, per_text), part_ids[ragged((np.cumsum(word_lengths) - word_lengths)[codes], lengths)]


def _different(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of texts, how many words each text has, and the numbers of all words."""
    lists = pc.ascii_split_whitespace(texts)
    found, sizes = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
    filled = pc.not_equal(found, "")
    words = found.filter(filled).dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64)
    return words.dictionary, _sums(filled.to_numpy(zero_copy_only=False).astype(np.int64), sizes), codes


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of the given sizes."""
    return np.diff(np.append(0, np.cumsum(values))[np.append(0, np.cumsum(sizes))])


# lower-case letters of ASCII and from U+00DF to U+00FF but the division sign
_PLAIN = re.compile("[a-zß-öø-ÿ]+")

# either side of a border: an ASCII digit or Latin-1 letter, and an ASCII mark other than an apostrophe
_WORDLY, _MARK = "[A-Za-z0-9À-ÖØ-öø-ÿ]", r"[!-&(-/:-@\[-`{-~]"


def borders_at_space(stated: dict) -> bool:
    """Whether the file's tokenizer drops white space and lets nothing reach across it."""
    normal, before = stated["normalizer"] or {}, stated["pre_tokenizer"] or {}
    steps = normal.get("normalizers", [normal])
    cuts = before.get("pretokenizers", [before])
    spaces = [step for step in steps if step.get("type") == "Replace"]
    return (
        all(step.get("type") in ("NFC", "Lowercase", "Replace") for step in steps)
        and [(step["pattern"], step["content"]) for step in spaces] == [({"Regex": r"\s+"}, " ")]
        and cuts[0].get("type") == "Split"
        and cuts[0].get("behavior") == "Removed"
        and cuts[0].get("invert") is True
        and not any(len(token["content"].split()) != 1 for token in stated["added_tokens"])
        and all(cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") for cut in cuts[1:])
    )


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 1) -> None:
    """Encode `docs.text` into files of `folder`, in ascending doc_id order over files and within them.

    Texts are range-partitioned before they are encoded, so only texts are shuffled and each is encoded once. A NULL text
    is empty (the end id alone); NULL ids come first; rows that share a doc_id stay apart, in the order of their texts'
    hashes, and a range may end between them. Other columns of `docs` are not read."""
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), tie)
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, position = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            lengths, ids = encoder(tokenizer).encode(batch.column("text"))
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                lengths = lengths + 1
            offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
            yield pa.record_batch(
                [
                    pa.array(np.full(len(lengths), file, np.int32)),
                    pa.array(np.arange(position, position + len(lengths))),
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(lengths),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))),
                ],
                ["file", "position", "doc_id", "n_tokens", "ids"],
            )
            position += len(lengths)

    ordered.mapInArrow(encode, SCHEMA).write.options(**FORMAT).parquet(folder)


def read_tokens(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """file, position, doc_id, n_tokens, ids; with bounds, only pages whose index says that they may hold such ids.

    Columns that a query does not use are not read: metadata alone costs no token pages."""
    rows = spark.read.schema(SCHEMA).parquet(folder)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def with_starts(rows: DataFrame) -> DataFrame:
    """`rows` (file, position, n_tokens and more, without ids) with start: the tokens of all documents before.

    Sums of files, one row each, are added up over files; a second running sum stays within a file."""
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("_file_tokens"))
    before = F.sum("_file_tokens").over(Window.orderBy("file")) - F.col("_file_tokens")
    files = files.select("file", before.alias("_before"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("position")) - F.col("n_tokens")
    rows = rows.withColumn("_within", within).join(files, "file")
    return rows.withColumn("start", F.col("_before") + F.col("_within")).drop("_before", "_within")


def ids_crc32(rows: DataFrame) -> DataFrame:
    """file, position, doc_id, n_tokens, ids_crc32 of `read_tokens`: crc32 of the ids as little-endian 32-bit numbers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            ends = lists.offsets.to_numpy().astype(np.int64) * 4
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            kept = [batch.column(name) for name in ("file", "position", "doc_id", "n_tokens")]
            yield pa.record_batch([*kept, pa.array(crc, pa.int64())], ["file", "position", "doc_id", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(sums, "file int, position long, doc_id long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row of `docs`, from files written in the shared folder and read back.

    Empty texts have the end id alone; an empty table gives no rows; repeated rows each have a place of their own."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    write_tokens(docs, tokenizer, folder, end_id)
    # the digests are needed twice, the token pages once
    digests = stored(ids_crc32(read_tokens(spark, folder)), "digests")
    return with_starts(digests).select("doc_id", "start", "n_tokens", "ids_crc32")
