"""Token counts by rank-synchronous merging of ragged arrays of byte-level BPE symbols."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose counts a Python worker remembers.
REMEMBERED = 1_000_000

NO_RANK = np.iinfo(np.int64).max


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 itself, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in set(shown)]
    return {byte: chr(byte) for byte in shown} | {byte: chr(256 + at) for at, byte in enumerate(hidden)}


class Merger:
    """Counts of the symbols that survive all merges of a byte-level BPE vocabulary (a tokenizers file)."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        vocabulary = stated["model"]["vocab"]
        self.width = max(vocabulary.values()) + 1
        letters = byte_letters()
        self.symbols = np.array([vocabulary[letters[byte]] for byte in range(256)], np.int64)
        merges = [merge.split(" ") if isinstance(merge, str) else merge for merge in stated["model"]["merges"]]
        keys = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        special = sorted((token["content"] for token in stated["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def merge_all(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each non-empty piece. In each step, every piece applies its own lowest-ranked pair everywhere."""
        coded = [piece.encode() for piece in pieces]
        counts = np.fromiter(map(len, coded), np.int64, len(coded))
        symbol = self.symbols[np.frombuffer(b"".join(coded), np.uint8)]
        owner = np.repeat(np.arange(len(coded)), counts)
        while len(symbol) > 1:
            pair = symbol[:-1] * self.width + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (owner[:-1] == owner[1:]), self.ranks[at], NO_RANK)
            rank = np.append(rank, NO_RANK)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(first, len(owner)))
            best = np.minimum.reduceat(rank, first)
            going = np.repeat(best < NO_RANK, lengths)  # pieces without a pair are finished
            best, symbol, owner, rank = np.repeat(best, lengths)[going], symbol[going], owner[going], rank[going]
            hit = np.flatnonzero(rank == best)
            if not len(hit):
                break
            # in a run of overlapping equal pairs, every second one from the left is merged
            opens = np.append(True, np.diff(hit) != 1)
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(opens, np.arange(len(hit)), 0))
            hit = hit[place % 2 == 0]
            symbol[hit] = self.merged[rank[hit]]
            counts -= np.bincount(owner[hit], minlength=len(counts))
            stays = np.ones(len(symbol), bool)
            stays[hit + 1] = False
            symbol, owner = symbol[stays], owner[stays]
        return counts

    def count(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        lists, extra = [], np.zeros(len(texts), np.int64)
        for at, text in enumerate(texts):
            if self.special is not None and (found := self.special.findall(text)):
                extra[at] = len(found)
                lists.append([piece for part in self.special.split(text) for piece in self.pieces(part)])
            else:
                lists.append(self.pieces(text))
        fresh = list(set().union(*lists).difference(self.known)) if lists else []
        if fresh:
            self.known.update(zip(fresh, self.merge_all(fresh).tolist()))
        count = self.known.__getitem__
        return extra + np.fromiter((sum(map(count, pieces)) for pieces in lists), np.int64, len(lists))


@lru_cache(maxsize=4)
def merger(path: str, pattern: str) -> Merger:
    return Merger(path, pattern)


def token_count(text: Column, path: str, pattern: str) -> Column:
    """Tokens of a text, without added begin or end; a special token's string counts as that one token. NULL is empty.

    `path` names a tokenizers file that every worker has, `pattern` the expression that cuts texts into pre-tokens."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        whole = texts.fillna("").tolist()
        counts = [merger(path, pattern).count(whole[at : at + 512]) for at in range(0, len(whole), 512)]
        return pd.Series(np.concatenate([np.zeros(0, np.int64), *counts]))

    return count(text)


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of `docs`.

    One pass without a shuffle; texts of any length count whole. A NULL text is an empty one (0 bytes, 0 tokens), a NULL
    doc_id stays, repeated rows each get a row, an empty table gives none; other columns of `docs` are not looked at."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), token_count(F.col("text"), path, pattern).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
