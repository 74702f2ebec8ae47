"""SentencePiece encoding and decoding with a relational lattice and a fold over its edges."""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textledger.llm.common import give_back, giving_back, head_count, let, ragged, slices
from textledger.sources.shared import stored

#: Segments whose ids every task may hold (18 bytes each); the ids of others are joined.
HELD_SEGMENTS = 4_000_000

#: Longer segments, where no border cuts them, are folded where they stand.
SEGMENT_CHARS = 64

#: Segments that a task counts before it passes its counts on.
COUNTED = 400_000
SPACE = "▁"


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model of the merging kind (BPE) with byte fallback, without normalisation."""

    ids: dict[str, int]
    scores: dict[str, float]
    texts: list[bytes]  # of each id
    byte_id: int  # of byte 0; the others follow
    longest: int
    joints: pa.Array  # pairs of letters that stand side by side in a piece, as numbers

    def split(self, found: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, bytes]:
        """Segments of chunks, one chunk after the other, their numbers of letters, the number of each chunk's segments, and
        all letters as UTF-8: chunks are cut where no piece reaches across, as merges on either side do not meet."""
        whole = pc.if_else(pc.starts_with(found, SPACE), found, pc.binary_join_element_wise(SPACE, found, ""))
        line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole), "")[0].as_buffer()
        letters = np.frombuffer(str(line, "utf-8").encode("utf-32-le"), np.uint32)
        pairs = (letters[:-1].astype(np.uint64) << np.uint64(32)) | letters[1:]
        cuts = np.append(~pc.is_in(pa.array(pairs), self.joints).to_numpy(zero_copy_only=False), True)
        ends = np.cumsum(pc.utf8_length(whole).to_numpy())
        cuts[ends - 1] = True
        stops = np.flatnonzero(cuts) + 1
        sizes = 1 + (letters >= 0x80).astype(np.int8) + (letters >= 0x800) + (letters >= 0x10000)
        offsets = np.append(0, np.cumsum(sizes, dtype=np.int32)[stops - 1]).astype(np.int32)
        segments = pa.StringArray.from_buffers(len(stops), pa.py_buffer(offsets), line)
        return segments, np.diff(stops, prepend=0), np.diff(np.searchsorted(stops, ends, "right"), prepend=0), line.to_pybytes()

    def fold(self, segment: str) -> list[int]:
        """The fold below in numpy, for long segments: every step merges the best pair wherever it stands."""
        n = len(segment)
        found = [
            (self.scores[piece], start, end)
            for start in range(n)
            for end in range(start + 2, min(n, start + self.longest) + 1)
            if (piece := segment[start:end]) in self.ids
        ]
        end_of = np.append(np.arange(1, n + 1), 0)
        if found:
            score, start, end = (np.array(column) for column in zip(*found))
            while True:
                middle = end_of[start]
                fits = (middle > 0) & (middle < end) & (end_of[middle] == end)
                if not fits.any():
                    break
                at = np.flatnonzero(fits & (score == score[fits].max()))
                place = np.cumsum(np.append(0, start[at][1:] != middle[at][:-1]))  # chains of pairs that overlap
                first = np.flatnonzero(np.append(True, np.diff(place) != 0))
                at = at[(np.arange(len(at)) - first[place]) % 2 == 0]
                end_of[middle[at]] = 0
                end_of[start[at]] = end[at]
        ids = []
        for at in np.flatnonzero(end_of[:n]).tolist():
            piece = segment[at : end_of[at]]
            ids += [self.ids[piece]] if piece in self.ids else [self.byte_id + byte for byte in piece.encode()]
        return ids


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    names = [model.id_to_piece(at) for at in every]
    plain = [at for at in every if not (model.is_byte(at) or model.is_control(at) or model.is_unknown(at))]
    byte_id = model.piece_to_id("<0x00>")
    if any(map(model.is_unused, every)) or any(names[byte_id + at] != f"<0x{at:02X}>" for at in range(256)):
        raise ValueError("a model with byte fallback and without unused pieces is needed")
    if any(SPACE in names[at].lstrip(SPACE) for at in plain):
        raise ValueError("pieces must not reach over words")
    texts = [bytes([at - byte_id]) if byte_id <= at < byte_id + 256 else b"" for at in every]
    for at in plain:
        texts[at] = names[at].replace(SPACE, " ").encode()
    ids = {names[at]: at for at in plain}
    joints = {ord(a) << 32 | ord(b) for name in ids for a, b in zip(name, name[1:])}
    joints = pa.array(sorted(joints), pa.uint64())
    return Pieces(ids, {names[at]: model.get_score(at) for at in plain}, texts, byte_id, max(map(len, ids)), joints)


_CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def chunks(text: str) -> list[str]:
    """Words with the spaces before them (and spaces at the end), after one space put before the text. A word after just
    one space stands for itself, any other chunk is written with its spaces."""
    if not text:
        return []
    if "  " not in text and SPACE not in text and text[0] != " " != text[-1]:
        return text.split(" ")
    found = _CHUNKS.findall(SPACE + text.replace(" ", SPACE))
    return [chunk[1:] if len(chunk) > 1 and chunk[1] != SPACE else chunk for chunk in found]


def numbered_chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different chunks of `texts`, the numbers of their chunks in a row, and how many each text has."""
    texts = texts.fill_null("").cast(pa.string())
    odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE))
    odd = pc.or_(pc.or_(odd, pc.equal(texts, "")), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
    odd = odd.to_numpy(zero_copy_only=False)
    plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    others = [chunks(text) for text in texts.filter(pa.array(odd)).to_pylist()]
    sizes = np.zeros(len(texts), np.int64)
    sizes[~odd], sizes[odd] = pc.list_value_length(plain).to_numpy(), [len(each) for each in others]
    coded = pa.concat_arrays([plain.flatten(), pa.array(chain.from_iterable(others), pa.string())]).dictionary_encode()
    codes = coded.indices.to_numpy()
    if others:
        places = np.argsort(odd, kind="stable")  # of texts, as they lie in `coded`
        starts = np.zeros(len(texts), np.int64)
        starts[places] = np.cumsum(sizes[places]) - sizes[places]
        codes = codes[ragged(starts, sizes)]
    return coded.dictionary, codes, sizes


def summed(segments: list[pa.Array], n: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Different segments and the sums of their counts."""
    coded = pa.concat_arrays(segments).dictionary_encode()
    sums = np.bincount(coded.indices.to_numpy(), np.concatenate(n), len(coded.dictionary))
    return coded.dictionary, sums.astype(np.int64)


def hashes(segments: pa.Array) -> np.ndarray:
    each = segments.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, each), np.uint64, len(each))


def _segment_counts(docs: DataFrame, path: str) -> DataFrame:
    """segment, n: how often each segment of at most `SEGMENT_CHARS` occurs in `docs.text`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _LAST.clear()  # the ids of an earlier corpus, which a worker that is used again would hold all the while
        table, seen = pieces(path), []

        def out() -> Iterator[pa.RecordBatch]:
            segments, n = summed(*map(list, zip(*seen)))
            seen.clear()
            yield from slices(iter([pa.record_batch([segments, pa.array(n)], ["segment", "n"])]), 10_000)

        for batch in slices(batches):
            found, codes, _ = numbered_chunks(batch.column(0))
            if not len(found):
                continue
            segments, letters, sizes, _ = table.split(found)
            n, short = np.repeat(np.bincount(codes, minlength=len(found)), sizes), letters <= SEGMENT_CHARS
            seen.append(summed([segments.filter(pa.array(short))], [n[short]]))
            if sum(len(each) for each, _ in seen) > COUNTED:
                yield from out()
        if seen:
            yield from out()

    parts = docs.select("text").mapInArrow(giving_back(count), "segment string, n long")
    return parts.groupBy("segment").agg(F.sum("n").alias("n"))


def is_loose(piece: str, scores: dict[str, float]) -> bool:
    """Whether the merge to `piece` may come up after one of lower or equal score, to a piece that it begins or ends with."""
    inner = (part for at in range(2, len(piece)) for part in (piece[:at], piece[-at:]))
    return any(scores.get(part, math.inf) <= scores[piece] for part in inner)


def lattice(segments: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """segment, n, edges (score, start, end, id, loose): all substrings of two letters or more and of bounded length that
    are pieces, by segment.

    `table` (piece, score, id, loose) has the size of the model, so it is broadcast; `segments` come from an aggregation by
    segment, so that the edges of a segment meet without another shuffle."""
    rows = segments.select("segment", "n", F.length("segment").alias("chars"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("chars") - 2, F.lit(0)))).alias("start"))
    # a segment without any piece stays by its first, empty substring
    least = F.when(F.col("start") == 0, 0).otherwise(F.col("start") + 2)
    rows = rows.select("*", F.explode(F.sequence(least, F.least("chars", F.col("start") + longest))).alias("end"))
    rows = rows.withColumn("part", F.substring("segment", F.col("start") + 1, F.col("end") - F.col("start")))
    rows = rows.join(F.broadcast(table), F.col("part") == F.col("piece"), "left").where("id IS NOT NULL OR end = 0")
    edge = F.when(F.col("id").isNotNull(), F.struct("score", "start", "end", "id", "loose"))
    return rows.groupBy("segment").agg(F.first("n").alias("n"), F.collect_list(edge).alias("edges"))


def fold(segment: Column, edges: Column, byte_id: int, letters: dict[str, int]) -> Column:
    """Ids of a segment from its lattice and the ids of pieces of one letter, with a higher-order aggregate.

    The state has for each letter the end of the symbol that begins there, or 0. A step merges the two neighbours that an
    edge covers together, of the best score, leftmost first, as models of the merging kind want it (the path of the best
    sum would give other pieces). Symbols that are no piece become their bytes.

    A single pass over the edges, best first, takes these steps unless a step lets a better edge apply than its own, which
    only `loose` pieces can be. Segments where that happens look at all edges in every step."""
    chars = F.length(segment)
    singles = sorted(letters, key=lambda letter: (letter != SPACE, letter))  # common ones are found first
    single_ids = F.split(F.lit(" ".join(str(letters[each]) for each in singles)), " ").cast("array<int>")

    def applies(ends: Column, edge: Column) -> Column:
        middle = F.get(ends, edge["start"])
        return (middle > 0) & (F.get(ends, middle) == edge["end"])

    def step(joins: Column, ends: Column) -> Column:
        ready = F.filter(joins, lambda edge: applies(ends, edge))
        ranked = F.transform(ready, lambda edge: F.struct(edge["score"].alias("score"), (-edge["start"]).alias("left"), edge["end"].alias("end")))
        return let(F.array_max(ranked), lambda best: F.when(best.isNull(), ends).otherwise(merged(ends, -best["left"], best["end"])))

    def merged(ends: Column, start: Column, stop: Column) -> Column:
        middle = F.get(ends, start)
        return F.transform(ends, lambda end, at: F.when(at == start, stop).when(at == middle, 0).otherwise(end))

    def ranked(joins: Column) -> Column:
        """The edges in the order of `step`."""
        back = lambda edge: (-edge["end"]).alias("back")
        order = lambda edge: (-edge["score"]).alias("order")
        return F.sort_array(F.transform(joins, lambda edge: F.struct(order(edge), edge["start"].alias("start"), back(edge), edge["end"].alias("end"), edge["loose"].alias("loose"))))

    def one_pass(ranked: Column) -> Column:
        """The ends after all steps; NULL where the steps do not follow the order."""
        loose = F.filter(ranked, lambda edge: edge["loose"])
        return let(loose, lambda loose: F.aggregate(ranked, whole_letters(), lambda ends, edge: in_order(ends, edge, loose)))

    def in_order(ends: Column, edge: Column, loose: Column) -> Column:
        early = lambda after: F.exists(loose, lambda other: (other["order"] <= edge["order"]) & applies(after, other))
        step = let(merged(ends, edge["start"], edge["end"]), lambda after: F.when(~F.coalesce(early(after), F.lit(False)), after))
        return F.when(applies(ends, edge), step).otherwise(ends)

    def whole_letters() -> Column:
        return F.transform(F.sequence(F.lit(0), chars - 1), lambda at: at + 1)

    def all_steps(joins: Column) -> Column:
        # one step more than merges are possible changes nothing; without joins there is none
        steps = F.slice(F.sequence(F.lit(1), chars), F.lit(1), F.least(chars, F.size(joins)))
        return F.aggregate(steps, whole_letters(), lambda ends, _: step(joins, ends))

    def one_letter(start: Column) -> Column:
        letter = F.substring(segment, start + 1, F.lit(1))
        place = F.instr(F.lit("".join(singles)), letter)
        return let(place, lambda place: F.when(place > 0, F.array(F.get(single_ids, place - 1))).otherwise(bytes_of(letter)))

    def bytes_of(letter: Column) -> Column:
        byte = lambda at: F.conv(F.hex(F.substring(letter.cast("binary"), at, F.lit(1))), 16, 10).cast("int")
        return F.transform(F.sequence(F.lit(1), F.octet_length(letter)), lambda at: byte(at) + byte_id)

    def ids(ends: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), chars - 1), lambda at: F.get(ends, at) > 0)
        whole = F.filter(edges, lambda edge: F.get(ends, edge["start"]) == edge["end"])
        return let(whole, lambda edges: F.flatten(F.transform(starts, lambda at: symbol(edges, at))))

    def symbol(edges: Column, at: Column) -> Column:
        own = F.transform(F.filter(edges, lambda edge: edge["start"] == at), lambda edge: edge["id"])
        return F.when(F.size(own) > 0, own).otherwise(one_letter(at))

    def steps_of(joins: Column) -> Column:
        return F.coalesce(let(ranked(joins), one_pass), all_steps(joins))

    return let(let(edges, steps_of), ids)


def piece_table(spark: SparkSession, model: Pieces) -> DataFrame:
    """piece, score, id, loose of all pieces of two letters or more; from Arrow, as plain rows would start Python workers of
    another kind beside those that count and encode."""
    names = [piece for piece in model.ids if len(piece) > 1]
    columns = {
        "piece": pa.array(names, pa.string()),
        "score": pa.array([model.scores[piece] for piece in names], pa.float64()),
        "id": pa.array([model.ids[piece] for piece in names], pa.int32()),
        "loose": pa.array([is_loose(piece, model.scores) for piece in names], pa.bool_()),
    }
    return spark.createDataFrame(pa.table(columns))


def encoded_segments(docs: DataFrame, path: str) -> DataFrame:
    """segment, n, ids of every segment of the texts that is not longer than `SEGMENT_CHARS`."""
    model = pieces(path)
    letters = {piece: at for piece, at in model.ids.items() if len(piece) == 1}
    edges = lattice(_segment_counts(docs, path), piece_table(docs.sparkSession, model), model.longest)
    return edges.select("segment", "n", fold(F.col("segment"), F.col("edges"), model.byte_id, letters).alias("ids"))


class Held:
    """Ids of segments by 64-bit hashes. Nothing of the texts is kept from batch to batch."""

    def __init__(self, packed: tuple, path: str):
        self.keys, self.ends, self.ids = packed
        self.pieces = pieces(path)
        sizes = np.fromiter(map(len, self.pieces.texts), np.int64, len(self.pieces.texts))
        self.letters, self.stops, self.sizes = np.frombuffer(b"".join(self.pieces.texts), np.uint8), np.cumsum(sizes), sizes

    def look_up(self, segments: pa.Array, letters: np.ndarray, more: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each segment in a row, their numbers, and places of segments whose ids are neither held nor in `more`."""
        keys = hashes(segments)
        at = np.searchsorted(self.keys, keys)
        held = at < len(self.keys)
        held[held] = self.keys[at[held]] == keys[held]
        lengths = np.zeros(len(segments), np.int64)
        lengths[held] = self.ends[at[held] + 1] - self.ends[at[held]]
        others, lacking = {}, []
        places = np.flatnonzero(~held)
        for place, segment in zip(places.tolist(), segments.take(pa.array(places)).to_pylist()):
            ids = self.pieces.fold(segment) if letters[place] > SEGMENT_CHARS else more.get(segment)
            if ids is None:
                lacking.append(place)
            else:
                others[place], lengths[place] = ids, len(ids)
        begins = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), np.int32)
        out[ragged(begins[held], lengths[held])] = self.ids[ragged(self.ends[at[held]], lengths[held])]
        for place, ids in others.items():
            out[begins[place] : begins[place] + len(ids)] = ids
        return out, lengths, np.array(lacking, np.int64)

    def encode(self, texts: pa.Array, more: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray, list[set[str]], bool]:
        """Ids of each text in a row, their numbers, segments whose ids are neither held nor in `more`, and whether each
        chunk's ids give the chunk again."""
        missing = [set() for _ in range(len(texts))]
        found, codes, sizes = numbered_chunks(texts)
        if not len(found):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), missing, True
        segments, letters, numbers, line = self.pieces.split(found)
        coded = segments.dictionary_encode()
        own = coded.indices.to_numpy()
        letters_of = np.zeros(len(coded.dictionary), np.int64)
        letters_of[own] = letters
        ids, lengths, lacking = self.look_up(coded.dictionary, letters_of, more)
        owner = np.repeat(np.arange(len(found)), numbers)
        if len(lacking):
            names = dict(zip(lacking.tolist(), coded.dictionary.take(pa.array(lacking)).to_pylist()))
            places = np.flatnonzero(np.isin(own, lacking))
            of_chunk: dict[int, set[str]] = {}
            for chunk, place in zip(owner[places].tolist(), own[places].tolist()):
                of_chunk.setdefault(chunk, set()).add(names[place])
            at = np.flatnonzero(np.isin(codes, list(of_chunk)))
            for text, chunk in zip(np.repeat(np.arange(len(texts)), sizes)[at].tolist(), codes[at].tolist()):
                missing[text] |= of_chunk[chunk]
        begins = np.cumsum(lengths) - lengths
        flat = ids[ragged(begins[own], lengths[own])]
        counts = np.bincount(owner, lengths[own], len(found)).astype(np.int64)
        starts = np.cumsum(counts) - counts
        whole = self.gives(flat, counts, found, line)
        ends = np.append(0, np.cumsum(counts[codes]))[np.append(0, np.cumsum(sizes))]
        return flat[ragged(starts[codes], counts[codes])], np.diff(ends), missing, whole

    def gives(self, ids: np.ndarray, counts: np.ndarray, found: pa.Array, line: bytes) -> bool:
        """Whether the ids of chunks, one chunk after the other, decode to the chunks, with spaces for U+2581."""
        sizes = self.sizes[ids]
        if self.letters[ragged(self.stops[ids] - sizes, sizes)].tobytes() != line.replace(SPACE.encode(), b" "):
            return False
        whole = pc.add(pc.binary_length(found), pc.subtract(1, pc.cast(pc.starts_with(found, SPACE), pa.int32())))
        expected = pc.subtract(whole, pc.multiply(2, pc.count_substring(found, SPACE))).to_numpy()
        return bool((np.bincount(np.repeat(np.arange(len(found)), counts), sizes, len(found)) == expected).all())


_LAST: dict[str, Held] = {}


def _unpack(shared, path: str) -> Held:
    """The broadcast ids, with what is remembered of them, once for each worker."""
    name, *packed = shared.value
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Held(tuple(packed), path)
    return _LAST[name]


def _pack(segments: DataFrame, pieces: int) -> tuple:
    """Hashes, ends and ids (below `pieces`) of segments, by hash, in few bytes; at most 4 million of them."""
    small = np.dtype(np.uint16 if pieces <= 1 << 16 else np.int32)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = hashes(batch.column("segment"))
            ends = np.append(0, np.cumsum(pc.list_value_length(batch.column("ids")).to_numpy() * small.itemsize)).astype(np.int32)
            flat = batch.column("ids").flatten().to_numpy().astype(small)
            ids = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            yield pa.record_batch([pa.array(keys.view(np.int64)), ids], ["key", "ids"])

    return by_key(segments.select("segment", "ids").mapInArrow(giving_back(hashed), "key long, ids binary").toArrow(), small)


def by_key(table: pa.Table, small: np.dtype, step: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, ends and ids, from rows of a key and the bytes of its ids. The rows go once they are read, and ids move
    in steps, as their places at once would take more than they do."""
    keys = table["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys).astype(np.int32)
    keys = keys[order]
    values = table["ids"].cast(pa.binary())
    del table
    lengths = pc.binary_length(values).to_numpy().astype(np.int32) // np.int32(small.itemsize)
    flat = np.frombuffer(b"".join(map(_bytes_of, values.chunks)), small)
    del values
    starts = np.cumsum(lengths, dtype=np.int32) - lengths
    ends = np.zeros(len(order) + 1, np.int32)
    np.cumsum(lengths[order], dtype=np.int32, out=ends[1:])
    ids = np.empty_like(flat)
    for at in range(0, len(order), step):
        some = order[at : at + step]
        ids[ends[at] : ends[at + len(some)]] = flat[ragged(starts[some], lengths[some])]
    return keys, ends, ids


def _bytes_of(column: pa.Array) -> memoryview:
    """The bytes of all values of a binary column without NULL, one after the other."""
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return memoryview(b"")
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(data)[offsets[0] : offsets[-1]]


def decode(ids: np.ndarray, texts: list[bytes]) -> str:
    """The text of ids, without the space that encoding put before it; bytes that are no UTF-8 become U+FFFD."""
    whole = b"".join(map(texts.__getitem__, ids.tolist()))
    return whole.removeprefix(b" ").decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, held: int = HELD_SEGMENTS) -> DataFrame:
    """doc_id, ids for each row of `docs`: the ids that the model's own library gives for the whole text.

    Every different segment of the corpus is encoded once, in the lattice. The ids of the `held` most frequent (by a
    threshold on their count) go to every task; a text with other segments is joined with theirs. A NULL text is empty
    and has no ids; U+2581 in a text reads as a space; NULL ids, repeated rows and empty tables stay as they are."""

    def ids(doc_id: pa.Array, texts: pa.Array, flat: np.ndarray, ends: np.ndarray, _: bool) -> pa.RecordBatch:
        return pa.record_batch([doc_id, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], ["doc_id", "ids"])

    return _encoded(docs, path, held, ids, "doc_id long, ids array<int>")


def _encoded(docs: DataFrame, path: str, held: int, shape: Callable, schema: str) -> DataFrame:
    """What `shape(doc_ids, texts, ids, ends, whole)` makes of each batch; `whole`: each chunk's ids give the chunk again."""
    rows = docs.select("doc_id", "text")
    segments = stored(encoded_segments(rows, path), "segments")
    least = head_count(segments, held)
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *_pack(segments.where(F.col("n") >= least), len(pieces(path).texts))))
    give_back()  # the driver's Python stands beside its JVM
    rare = segments.where(F.col("n") < least)

    def run(batches: Iterator[pa.RecordBatch], more: bool) -> Iterator[pa.RecordBatch]:
        store = _unpack(shared, path)
        for batch in slices(batches):
            own = {}
            if more:
                for a, b in zip(*(batch.column(name).to_pylist() for name in ("segments", "found"))):
                    own.update(zip(a or (), b or ()))
            flat, counts, missing, whole = store.encode(batch.column("text"), own)
            if any(missing):
                raise ValueError("a segment without ids")
            yield shape(batch.column("doc_id").cast(pa.int64()), batch.column("text"), flat, np.append(0, np.cumsum(counts)), whole)

    if rare.isEmpty():
        return rows.mapInArrow(giving_back(lambda batches: run(batches, False)), schema)

    def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _unpack(shared, path)
        for batch in slices(batches):
            missing = [sorted(each) for each in store.encode(batch.column("text"), {})[2]]
            yield pa.record_batch([batch.column("key"), pa.array(missing, pa.list_(pa.string()))], ["key", "missing"])

    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    needed = keyed.select("key", "text").mapInArrow(giving_back(lacking), "key long, missing array<string>")
    needed = needed.select("key", F.explode("missing").alias("segment")).distinct().join(rare.select("segment", "ids"), "segment")
    found = needed.groupBy("key").agg(F.collect_list(F.struct("segment", "ids")).alias("found"))
    found = found.select(F.col("key").alias("_key"), F.col("found.segment").alias("segments"), F.col("found.ids").alias("found"))
    joined = keyed.join(found, F.col("key") == F.col("_key"), "left").select("doc_id", "text", "segments", "found")
    return joined.mapInArrow(giving_back(lambda batches: run(batches, True)), schema)


def encode_digest(docs: DataFrame, path: str, held: int = HELD_SEGMENTS) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit numbers), round_trip (whether decoding the ids
    gives the text, with U+2581 read as a space) for each row of `docs`."""

    def digest(doc_id: pa.Array, texts: pa.Array, flat: np.ndarray, ends: np.ndarray, whole: bool) -> pa.RecordBatch:
        each = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        same = [True] * len(each)
        if not whole:  # what chunks decode to may still add up to the text
            plain = [(text or "").replace(SPACE, " ") for text in texts.to_pylist()]
            same = [decode(ids, pieces(path).texts) == text for ids, text in zip(each, plain)]
        crc = [zlib.crc32(ids.astype("<u4")) for ids in each]
        columns = [doc_id, pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
        return pa.record_batch(columns, ["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return _encoded(docs, path, held, digest, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
