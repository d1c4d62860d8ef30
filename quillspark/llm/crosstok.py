"""Cross-tokenizer alignment: token sequences of two tokenizers over the same bytes, cut where both end a token, and the links that overlap."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage_table

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A part is so many links of consecutive documents of a task, or one longer document; it looks up each of its id pairs once.
PART_LINKS = 2_000_000
#: Longer texts are tokenised and aligned in pieces of about so many characters, cut where both tokenizers start anew.
PIECE = 1 << 18
_CACHE = 400_000
#: One space between characters that are none: no token of either tokenizer reaches over its left side.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_UNEVEN = re.compile(r"^\s| \s|\s |\s$")


def align(ea: list[int], eb: list[int]) -> tuple[list[int], list[int]]:
    """(la, lb): the indexes of each pair of tokens that overlap, for the ends of two token sequences over the same bytes, no token empty.

    Where tokens go one to one, the ends of both are equal at an index shift: stretches of 1, 2, 4, ... tokens are
    compared at that shift while they are equal, then halved, which finds how far it holds. What follows is resolved
    token by token, by moving on behind the smaller end until both are equal, and gives the next shift.
    """
    n, i, j = len(ea), 0, 0
    la: list[int] = []
    lb: list[int] = []
    while i < n:
        k, h = i, j
        if ea[k] == eb[h]:
            k, h, step = k + 1, h + 1, 1
            while k < n and ea[k : k + step] == eb[h : h + step]:
                k, h, step = k + step, h + step, 2 * step
            if k > n:  # the last two slices were shorter
                k, h = n, h - (k - n)
            while step > 1 and k < n:
                step //= 2
                if ea[k : k + step] == eb[h : h + step]:
                    k, h = min(k + step, n), h + min(step, n - k)
            la.extend(range(i, k))
            lb.extend(range(j, h))
            if k == n:
                break
        x, y = ea[k], eb[h]
        la.append(k)
        lb.append(h)
        while x != y:
            if x < y:
                k += 1
                x = ea[k]
            else:
                h += 1
                y = eb[h]
            la.append(k)
            lb.append(h)
        i, j = k + 1, h + 1
    return la, lb


def group_starts(la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Which links open a group: those that have neither token with the link before them."""
    return np.flatnonzero(np.concatenate(([True], (la[1:] != la[:-1]) & (lb[1:] != lb[:-1])))) if len(la) else np.empty(0, np.int64)


class Tokens(NamedTuple):
    """Ids of both tokenizers for a piece of text and the byte offsets where they end."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray


class Pair:
    """Both tokenizers, and what they give for the words met so far.

    The first is a byte-level one whose pattern starts a new word at a single space between other characters; the second
    has no piece with a space behind anything else. So words cut there are tokenised once and put together, which gives
    the ids of the whole text. A word whose pieces don't spell it, as when it holds the piece alphabet's own sign for a
    space, is known to fail, and so does its text.
    """

    def __init__(self, first: str, second: str):
        import json

        import sentencepiece
        import tiktoken

        spec = json.load(open(first, encoding="utf-8"))["model"]  # noqa: SIM115
        entry = self._byte_level()
        ranks = {bytes(entry[c] for c in token): i for token, i in spec["vocab"].items() if all(c in entry for c in token)}
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.a_bytes[i] = raw
        # merges come in the order of the ids, so that ids serve as ranks; the special token's string is plain text
        merged = {raw: i for raw, i in ranks.items() if raw != b"<|endoftext|>"}
        self.first = tiktoken.Encoding("first", pat_str=self._pattern(), mergeable_ranks=merged, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece of the second tokenizer reaches over the start of a word")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # an id as text, with the mark behind it: within a group, at its end
        self.marked = np.array([f"{i}{m}".encode() for n, end in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")) for i in range(n) for m in ("," + end)])
        self._forget()

    @staticmethod
    def _pattern() -> str:
        import public_tokenizers

        return public_tokenizers.PATTERN

    @staticmethod
    def _byte_level() -> dict[str, int]:
        """The byte that each character of a byte-level entry stands for: printable ones themselves, the others from 256 on."""
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(own)]
        return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.pools = [[np.empty(0, np.int32)], [np.empty(0, np.int32)]]
        self.sizes = [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
        self.fails = [np.empty(0, bool)]

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.codes]
        if not fresh:
            return
        if len(self.codes) + len(fresh) > _CACHE and self.codes:
            self._forget()
            fresh = list(words)
        ids = [self.first.encode_ordinary(" " + w) for w in fresh], self.second.encode(fresh, num_threads=1)
        fails = [b"".join(map(self.b_bytes.__getitem__, b)) != (" " + w).encode() or b"".join(map(self.a_bytes.__getitem__, a)) != (" " + w).encode() for w, a, b in zip(fresh, *ids, strict=True)]
        n = len(self.codes)
        self.codes.update(zip(fresh, range(n, n + len(fresh)), strict=True))
        for k in (0, 1):
            self.pools[k] = [np.concatenate([*self.pools[k], np.fromiter((i for x in ids[k] for i in x), np.int32)])]
            self.sizes[k] = [np.concatenate([*self.sizes[k], np.fromiter(map(len, ids[k]), np.int64, len(fresh))])]
        self.fails = [np.concatenate([*self.fails, np.array(fails, bool)])]

    def groups_text(self, t: Tokens, ga: np.ndarray, gb: np.ndarray) -> bytes:
        """`a1,a2|b1;a3|b2,b3;` for groups that start at these indexes."""
        na, nb = len(t.a), len(t.b)
        a_end, b_end = np.append(ga[1:], na), np.append(gb[1:], nb)
        codes = np.empty(na + nb, np.int64)
        last_a, last_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
        last_a[a_end - 1] = last_b[b_end - 1] = 1
        codes[np.arange(na) + np.repeat(gb, a_end - ga)] = t.a * 2 + last_a
        codes[np.arange(nb) + np.repeat(a_end, b_end - gb)] = (t.b + len(self.a_bytes)) * 2 + last_b
        return self.marked[codes].tobytes().translate(None, b"\0")

    def tokens(self, texts: list[str]) -> list[Tokens | None]:
        """Of each text, which starts at a word; None where it fails."""
        words = [_CUT.split(t) if _UNEVEN.search(t) else t.split(" ") for t in texts]
        self.learn(set(chain.from_iterable(words)))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(words)), np.int64)
        ends = np.cumsum([len(x) for x in words])
        failed = np.add.reduceat(self.fails[0][codes], np.concatenate(([0], ends[:-1]))) > 0 if len(codes) else np.zeros(0, bool)
        sides = []
        for k, size in ((0, self.a_size), (1, self.b_size)):
            length = self.sizes[k][0][codes]
            upto = np.cumsum(length)
            first = np.cumsum(self.sizes[k][0]) - self.sizes[k][0]
            ids = self.pools[k][0][np.repeat(first[codes] - (upto - length), length) + np.arange(upto[-1] if len(upto) else 0)]
            sides.append((ids, np.cumsum(size[ids]), upto[ends - 1]))
        out, starts = [], [0, 0]
        for t in range(len(texts)):
            cut = [slice(starts[k], int(sides[k][2][t])) for k in (0, 1)]
            starts = [c.stop for c in cut]
            if failed[t]:
                out.append(None)
                continue
            a, b = (sides[k][0][cut[k]] for k in (0, 1))
            at = [int(sides[k][1][cut[k].start - 1]) if cut[k].start else 0 for k in (0, 1)]
            out.append(Tokens(a, b, *(sides[k][1][cut[k]] - at[k] for k in (0, 1))))
        return out


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(first: str | None, second: str | None) -> Pair:
    if first is None or second is None:
        import public_tokenizers

        first, second = first or public_tokenizers.path(FIRST), second or public_tokenizers.path(SECOND)
    if (first, second) not in _PAIRS:
        _PAIRS[first, second] = Pair(first, second)
    return _PAIRS[first, second]


def _pieces(text: str) -> list[str]:
    """text cut before a single space between other characters, which goes, about every PIECE characters."""
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = _CUT.search(text, at + PIECE - 1)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]]


class Aligned(NamedTuple):
    """Of one text: the two token sequences, their groups as text pieces, and an id pair a link."""

    a: np.ndarray
    b: np.ndarray
    groups: list[bytes]
    n_groups: int
    links: np.ndarray


_NONE = np.empty(0, np.int64)


def aligned(pair: Pair, texts: list[str | None]) -> Iterator[Aligned]:
    """Of each text in order, an empty one for null and empty texts and for those that a tokenizer doesn't spell."""
    pieces = [_pieces(t) if t else [] for t in texts]
    found = iter(pair.tokens([p for x in pieces for p in x]) if any(pieces) else [])
    for x in pieces:
        own = [next(found) for _ in x]
        if not own or any(t is None for t in own):
            yield Aligned(_NONE, _NONE, [], 0, _NONE)
            continue
        groups, n_groups, links = [], 0, []
        for t in own:
            la, lb = map(np.array, align(t.a_ends.tolist(), t.b_ends.tolist()))
            starts = group_starts(la, lb)
            groups.append(pair.groups_text(t, la[starts], lb[starts]))
            n_groups += len(starts)
            links.append((t.a[la].astype(np.int64) << 32) | t.b[lb])
        yield Aligned(np.concatenate([t.a for t in own]), np.concatenate([t.b for t in own]), groups, n_groups, np.concatenate(links))


def _batches(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, 256):
        yield b.slice(at, 256)


def align_texts(docs: DataFrame, keys: list[str], first: str | None = None, second: str | None = None, text: str = "text") -> DataFrame:
    """keys, a_ids, b_ids, n_groups, groups (`a1,a2|b1;a3|b2,b3`) and links, the id pairs (a << 32 | b) of all overlapping tokens.

    Each row of docs gives a row, repeated ones as often as they come, an empty table none. Null and empty texts, and
    those that a tokenizer doesn't spell byte for byte, have no tokens. first and second are paths that every executor
    has; by default the files of the installed package of public tokenizers. No shuffle; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(first, second)
        for b in (x for big in batches for x in _batches(big)):
            rows = list(aligned(pair, b.column("align_text").to_pylist()))
            cols = [pa.array([r.a for r in rows], pa.list_(pa.int32())), pa.array([r.b for r in rows], pa.list_(pa.int32())), pa.array([r.n_groups for r in rows], pa.int64()), pa.array([b"".join(r.groups)[:-1].decode() for r in rows], pa.string()), pa.array([r.links for r in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *cols], names=[*keys, "a_ids", "b_ids", "n_groups", "groups", "links"])

    rows = docs.select(*keys, F.col(text).alias("align_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, a_ids array<int>, b_ids array<int>, n_groups bigint, groups string, links array<bigint>")


def _sha256(groups: list[bytes]) -> str:
    h = hashlib.sha256()
    for g in groups[:-1]:
        h.update(g)
    h.update(memoryview(groups[-1])[:-1])  # no mark at the very end
    return h.hexdigest()


def _parts(docs: DataFrame, keys: list[str], first: str | None, second: str | None, text: str, part_links: int) -> DataFrame:
    """A row for each part: its documents' columns as arrays, its id pairs, how many of its documents hold each, and by document which it holds how often."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.select(*keys).schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(first, second)
        names: list[pa.RecordBatch] = []
        rows: list[tuple] = []
        links: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            codes, pairs = pd.factorize(np.concatenate([*links, _NONE]))
            held, ends, steps, times, at = np.zeros(len(pairs), np.int64), [], [], [], 0
            for x in links:
                own, n = np.unique(codes[at : at + len(x)], return_counts=True)
                held[own] += 1
                steps.append(np.diff(own, prepend=0))
                times.append(n)
                ends.append(len(own))
                at += len(x)
            table = pa.Table.from_batches(names)
            flat = lambda v, t: pa.array([v], pa.list_(t))
            cols = [pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table.column(k).combine_chunks()) for k in keys]
            cols += [flat([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            cols += [flat(pairs, pa.int64()), flat(held, pa.int64()), flat(np.array(ends, np.int32), pa.int32()), flat(np.concatenate([*steps, _NONE]).astype(np.int32), pa.int32()), flat(np.concatenate([*times, _NONE]).astype(np.int32), pa.int32())]
            out = pa.RecordBatch.from_arrays(cols, names=[*(f"key_{k}" for k in range(len(keys))), "n_a", "n_b", "n_groups", "n_links", "sha", "pairs", "held", "n_own", "steps", "times"])
            names.clear(), rows.clear(), links.clear()
            return out

        n = 0
        for b in (x for big in batches for x in _batches(big)):
            for k, r in enumerate(aligned(pair, b.column("align_text").to_pylist())):
                names.append(b.select(keys).slice(k, 1))
                rows.append((len(r.a), len(r.b), r.n_groups, len(r.links), _sha256(r.groups) if r.groups else ""))
                links.append(r.links)
                n += len(r.links)
                if n >= part_links or len(rows) >= 100_000:
                    yield flush()
                    n = 0
        if rows:
            yield flush()

    schema = [*(f"key_{k} array<{kinds[c]}>" for k, c in enumerate(keys)), "n_a array<bigint>", "n_b array<bigint>", "n_groups array<bigint>", "n_links array<bigint>", "sha array<string>", "pairs array<bigint>", "held array<bigint>", "n_own array<int>", "steps array<int>", "times array<int>"]
    return docs.select(*keys, F.col(text).alias("align_text")).mapInArrow(run, ", ".join(schema))


def score_alignments(docs: DataFrame, keys: list[str], first: str | None = None, second: str | None = None, text: str = "text", part_links: int = PART_LINKS) -> DataFrame:
    """keys, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document's alignment (align_texts).

    An id pair's count is how many documents hold it linked, over all of docs; n_best is the number of a document's links
    whose count is the highest of their first id, ties included, count_sum adds up the counts of its links. The digest of
    no groups is empty. Texts are tokenised once and aligned in parts; a part asks for each of its id pairs once, so what
    is shuffled are a part's different pairs, not the links of every document. An id has at most as many pairs as the
    other vocabulary has ids, which bounds the window over one. Edge cases are those of align_texts.
    """
    parts = stage_table(_parts(docs, keys, first, second, text, part_links).withColumn("part", F.monotonically_increasing_id()), "aligned")
    asked = parts.select("part", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "x")).select("part", "at", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = asked.groupBy("pair").agg(F.sum("held").alias("n"))
    counts = counts.withColumn("is_best", F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("pair", 32))))
    counts = stage_table(counts, "pairs")
    # a count and whether it is the best in one long
    told = asked.select("part", "at", "pair").join(counts, "pair").select("part", F.struct("at", (F.col("n") * 2 + F.col("is_best").cast("int")).alias("v")).alias("x"))
    told = told.groupBy("part").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["v"]).alias("told"))  # of one part
    kinds = {f.name: f.dataType.simpleString() for f in docs.select(*keys).schema.fields}
    plain = ["n_a", "n_b", "n_groups", "n_links", "sha"]
    names = [*keys, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                get = lambda c: row.column(c).flatten()  # noqa: B023, E731
                ends = np.cumsum(get("n_own").to_numpy())
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                steps, times, v = (get(c).to_numpy() for c in ("steps", "times", "told"))
                filled = np.flatnonzero(ends > starts)
                # codes of a document are steps from 0, summed up within it
                run_up = np.cumsum(steps.astype(np.int64))
                codes = run_up - np.repeat((run_up - steps)[starts[filled]], (ends - starts)[filled])
                best, total = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
                if len(filled):
                    best[filled] = np.add.reduceat(times * (v[codes] & 1), starts[filled])
                    total[filled] = np.add.reduceat(times * (v[codes] >> 1), starts[filled])
                yield pa.RecordBatch.from_arrays([*(get(f"key_{i}") for i in range(len(keys))), *(get(c) for c in plain), pa.array(best), pa.array(total)], names=names)

    rows = parts.select("part", *(f"key_{i}" for i in range(len(keys))), *plain, "n_own", "steps", "times").join(told, "part", "left")
    rows = rows.withColumn("told", F.coalesce("told", F.array().cast("array<bigint>")))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"])
    return rows.drop("part").mapInArrow(run, schema)
