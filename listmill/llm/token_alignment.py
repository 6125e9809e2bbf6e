"""Cross-tokenizer alignment: distinct texts are tokenised by two tokenizers and aligned once, pairs counted corpus-wide."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

# bytes of the texts that are aligned in one go, and whose distinct pairs are looked up together
CHUNK_BYTES = 2 << 20
# bytes of the texts that are handed to the tokenizers in one call
PART_BYTES = 1 << 18
# texts that make up more than one row in HOT_SHARE are looked up through a broadcast; there are fewer than HOT_SHARE
HOT_SHARE = 2_000

# How the byte-level tokenizer parts a text, and characters whose class may depend on a library's Unicode version.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RARE = re.compile("[^\x00-\u024f\u2010-\u2027]")

_LONG = T.LongType()
MEASURES = ("n_a", "n_b", "n_groups", "n_links")
_TEXT = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("groups_sha256", T.StringType()), *[T.StructField(m, _LONG) for m in MEASURES]])
# a chunk: its texts, its distinct pairs with their counts, and per text the pairs it has (places in that list) and how often
_CHUNK = T.StructType([
    T.StructField("chunk", T.StringType()), T.StructField("texts", T.ArrayType(_TEXT)), T.StructField("pairs", T.ArrayType(_LONG)),
    T.StructField("links", T.ArrayType(_LONG)), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("has", T.ArrayType(T.IntegerType())),
    T.StructField("times", T.ArrayType(T.IntegerType())),
])


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else one from U+0100 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Two public tokenizers with the bytes of every id: a byte-level BPE (A) and a sentence-piece model (B)."""

    def __init__(self, path_a: str, path_b: str):
        # one thread a task: Spark has a task on every core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken

        self.path_a = path_a
        with open(path_a, encoding="utf-8") as f:
            said = json.load(f)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = byte_level()
        special = {t["content"]: t["id"] for t in said["added_tokens"]}
        entries = said["model"]["vocab"] | special
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for piece, i in entries.items():
            self.bytes_a[i] = piece.encode() if piece in special else bytes(back[c] for c in piece)
        # where merges are ranked in the order of their ids, the same merges can be run by the quicker library
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in said["model"]["merges"]]
        ordered = all(entries[x] < entries[y] for x, y in zip(made, made[1:]))
        ranks = {self.bytes_a[i]: i for piece, i in entries.items() if piece not in special}
        self.quick = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(p) for p in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        # decimal ids as rows of digits, with room for the mark that follows
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.n_digits = np.array([len(str(i)) for i in range(most)], np.int64)
        self.digits = np.zeros((most, int(self.n_digits.max()) + 1), np.uint8)
        for i in range(most):
            self.digits[i, : self.n_digits[i]] = list(str(i).encode())

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    @cached_property
    def a(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path_a)
        out.encode_special_tokens = True
        return out

    def _encode_a(self, texts: list[str]) -> list[list[int]]:
        """Ids by A. Texts of Latin letters and common signs, on whose classes all libraries agree, take the quick way."""
        out: list = [None if self.quick is None or _RARE.search(t) else self.quick.encode_ordinary(t) for t in texts]
        rest = [k for k, x in enumerate(out) if x is None]
        if rest:
            encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
            for k, e in zip(rest, encode([texts[k] for k in rest], add_special_tokens=False)):
                out[k] = e.ids
        return out

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of every text by A (of a blank and the text) and by B; none where joined bytes differ from blank and text."""
        out_a, out_b, none = [], [], np.zeros(0, np.int32)
        piece_a, piece_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for part in _parts(texts, PART_BYTES):
            a = self._encode_a([" " + (t or "") for t in part])
            b = self.b.encode([t or "" for t in part], num_threads=1)
            for t, x, y in zip(part, a, b):
                whole = (" " + t).encode("utf-8", "replace") if t else None
                same = whole is not None and b"".join(map(piece_a, x)) == whole and b"".join(map(piece_b, y)) == whole
                out_a.append(np.array(x, np.int32) if same else none)
                out_b.append(np.array(y, np.int32) if same else none)
        return out_a, out_b


def _parts(texts: list[str | None], limit: int) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t or "") > limit:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


_loaded: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """Read once a worker."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Tokenizers(path_a, path_b)
    return _loaded[path_a, path_b]


def align(texts: list[str | None], tok: Tokenizers) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Per text (n_a, n_b, n_groups, n_links, groups_sha256), and per link the text's number, the A id and the B id.

    The texts are laid end to end. Both tokenizers cover each text exactly, so all text ends are common ends, and one
    pass of array operations serves the whole chunk: every byte is marked where an A token, a B token or both end. Two
    tokens overlap in exactly one piece between neighbouring marks.
    """
    a, b = tok.encode(texts)
    count_a, count_b = (np.array([len(x) for x in of], np.int64) for of in (a, b))
    ids_a, ids_b = np.concatenate(a), np.concatenate(b)
    ends_a, ends_b = np.cumsum(tok.size_a[ids_a]), np.cumsum(tok.size_b[ids_b])
    marks = np.zeros((int(ends_a[-1]) if len(ends_a) else 0) + 1, np.uint8)
    marks[ends_a] = 1
    marks[ends_b] |= 2
    cuts = np.flatnonzero(marks)
    kind = marks[cuts]
    is_a, is_b, both = (kind & 1).astype(bool), (kind & 2).astype(bool), kind == 3
    # the token that a piece lies in is the one after those that ended before
    link_a, link_b, group = (np.cumsum(m) - m for m in (is_a, is_b, both))
    text_of = np.repeat(np.arange(len(texts)), count_a)[link_a]
    n_links = np.bincount(text_of, minlength=len(texts))
    # group by group, A ids then B ids, each followed by its mark
    group_a, group_b = group[is_a], group[is_b]
    in_a, in_b = (np.bincount(g, minlength=int(both.sum())) for g in (group_a, group_b))
    place_a = np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]
    ids = np.empty(len(ids_a) + len(ids_b), np.int32)
    follow = np.full(len(ids), ord(","), np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    follow[place_a[both[is_a]]], follow[place_b[both[is_b]]] = ord("|"), ord(";")
    sizes = tok.n_digits[ids]
    rows = tok.digits[ids]
    rows[np.arange(len(ids)), sizes] = follow
    listed = rows[np.arange(rows.shape[1]) <= sizes[:, None]].tobytes()
    at = np.append(0, np.cumsum(sizes + 1))[np.append(0, np.cumsum(count_a + count_b))]
    out = []
    for k in range(len(texts)):
        n_a, n_b, links = int(count_a[k]), int(count_b[k]), int(n_links[k])
        digest = hashlib.sha256(listed[at[k] : at[k + 1] - 1]).hexdigest() if n_a else ""
        # every common end saves one cut
        out.append((n_a, n_b, n_a + n_b - links, links, digest))
    return out, text_of, ids_a[link_a].astype(np.int64), ids_b[link_b].astype(np.int64)


def _chunk(rows: list[tuple], tok: Tokenizers) -> tuple:
    """One row of _CHUNK from (text, digest, copies) of its texts."""
    texts, digests, copies = zip(*rows)
    measures, text_of, a, b = align(list(texts), tok)
    pair = (a << 16) | b
    distinct, code = np.unique(pair, return_inverse=True)
    links = np.bincount(code, weights=np.asarray(copies, np.float64)[text_of], minlength=len(distinct)).astype(np.int64)
    held, times = np.unique((text_of << 32) | code, return_counts=True)
    ends = np.searchsorted(held, np.arange(1, len(texts) + 1) << 32)
    out = [{"digest": d, "groups_sha256": m[4], **dict(zip(MEASURES, m))} for d, m in zip(digests, measures)]
    return uuid.uuid4().hex, out, distinct, links, ends, held & 0xFFFFFFFF, times


def _align_all(distinct: DataFrame, paths: tuple[str, str], chunk_bytes: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, rows, size = _tokenizers(*paths), [], 0
        for batch in batches:
            for row in zip(batch["text"], batch["digest"], batch["copies"]):
                if rows and size + len(row[0] or "") > chunk_bytes:
                    yield pd.DataFrame([_chunk(rows, tok)], columns=_CHUNK.names)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[0] or "")
        if rows:
            yield pd.DataFrame([_chunk(rows, tok)], columns=_CHUNK.names)

    return distinct.mapInPandas(run, _CHUNK)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (A id and B id in one number), b, n: how many links of the corpus join them, copies of texts counted."""
    pairs = aligned.select(F.explode(F.arrays_zip("pairs", "links")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    return pairs.groupBy("pair").agg(F.sum("links").alias("n")).withColumn("b", F.expr("CAST(pair & 65535 AS INT)"))


def _measured(aligned: DataFrame, found: DataFrame) -> DataFrame:
    """Per distinct text its measures, n_best and count_sum, from what the corpus says on the pairs of its chunk."""
    schema = T.StructType([*_TEXT.fields, T.StructField("n_best", _LONG), T.StructField("count_sum", _LONG)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for texts, ends, has, times, known in zip(batch["texts"], batch["ends"], batch["has"], batch["times"], batch["known"]):
                n, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if known is not None and len(known):
                    at = np.array([k["place"] for k in known])
                    n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                    n[at], best[at] = [k["n"] for k in known], [k["best"] for k in known]
                has, times, starts = np.asarray(has, np.int64), np.asarray(times, np.int64), np.append(0, ends)
                sums, bests = (np.append(0, np.cumsum(v[has] * times)) for v in (n, best))
                out = pd.DataFrame(list(texts))
                out["n_best"], out["count_sum"] = np.diff(bests[starts]), np.diff(sums[starts])
                yield out[schema.names]

    return aligned.select("chunk", "texts", "ends", "has", "times").join(found, "chunk", "left").drop("chunk").mapInPandas(run, schema)


def alignments(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(one row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; pair counts).

    Texts are shuffled whole once, so that each distinct one is tokenised and aligned once; copies combine inside tasks
    before, so a text that a third of the rows share is no hot key. A task aligns its texts in chunks of ``chunk_bytes``
    (or one longer text) and hands on the distinct pairs of a chunk with their counts, times the copies of their texts.
    Counts come back to the chunk, at most as many as it has pairs, and texts get their sums there. B ids bound the
    table of highest counts (32,000 rows, broadcast). Measures join documents by SHA-256 of the text; the few texts that
    many documents share are joined by broadcast, less than HOT_SHARE of them at any size.

    A null or empty text, and one that the tokenizers don't give back byte for byte, has zeros and an empty digest.
    Repeated rows and null ids get a row each. Other columns aren't read. Empty tables give no rows and no pairs.
    """
    digest = F.sha2(F.col("text").cast("binary"), 256)
    rows = docs.select("doc_id", F.when(F.col("text") != "", F.unhex(digest)).alias("digest"))
    texts = docs.where(F.col("text") != "").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    distinct = texts.select("text", F.unhex(digest).alias("digest"), "copies")
    aligned = stored(_align_all(distinct, (path_a, path_b), chunk_bytes))
    counts = stored(pair_counts(aligned))
    highest = counts.groupBy("b").agg(F.max("n").alias("top"))
    judged = counts.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("top")).cast("int").alias("best"))
    asked = aligned.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    found = asked.join(judged, "pair").groupBy("chunk").agg(F.collect_list(F.struct("place", "n", "best")).alias("known"))
    measured = stored(_measured(aligned, found))
    total = rows.count()
    shared = rows.where(F.col("digest").isNotNull()).groupBy("digest").count().where(F.col("count") * HOT_SHARE > total).select("digest")
    hot = stored(measured.join(F.broadcast(shared), "digest"))
    numbers = [*MEASURES, "n_best", "count_sum"]
    by = rows.join(F.broadcast(hot.select("digest", F.struct(*numbers, "groups_sha256").alias("h"))), "digest", "left")
    # rows without text need no join, however many there are
    settled = F.col("h").isNotNull() | F.col("digest").isNull()
    cold = by.where(~settled).drop("h").join(measured, "digest", "left").select("doc_id", *numbers, "groups_sha256")
    out = by.where(settled).select("doc_id", "h.*").unionByName(cold)
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers]
    return out.select("doc_id", *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")), counts
