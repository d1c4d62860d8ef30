"""Best-fit packing of token sequences: linear grouping of large pieces, few-size configurations, best fit of the rest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import spare_names, stage_table

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces are dealt by hash into groups of about this many, each packed in one task; a group ends with one sequence
#: that is not full, so their number hardly matters.
GROUP = 32_768
#: Large pieces have more than capacity / SMALL tokens; their lengths are rounded up within SIZES groups.
SMALL, SIZES = 8, 24
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_END_MARKS = ".,!?;:%&$#*|-"
_CACHE_WORDS = 1_000_000


class Ids:
    """Token ids of whole texts, the same as the tokenizer gives.

    The tokenizer drops white space and never joins what stands on both sides of it, nor letters and marks, so words are
    numbered once for many texts and looked up, a word of plain letters in lower case and without the marks behind it.
    New words of plain letters are encoded many at once, without the normalizer, which leaves them as they are; all
    else, and any text with something like a special token, goes through the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        known = spec["normalizer"], spec["pre_tokenizer"], spec["model"].get("end_of_word_suffix")
        self.by_word = known[2] == "</w>" and "Lowercase" in str(known[0]) and "Removed" in str(known[1])
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.light = Tokenizer.from_str(json.dumps(spec)) if self.by_word else None
        self.closes = np.array([str(self.whole.id_to_token(i)).endswith("</w>") for i in range(self.whole.get_vocab_size())])
        # texts with these go through the tokenizer whole: special tokens, and controls that are no white space to it
        self.apart = "|".join([*(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()), r"[\x1c-\x1f]"])
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {"": 0}
        self.pool, self.sizes = [np.empty(0, "<u4")], [np.zeros(1, np.int64)]  # the ids and lengths of the codes, in blocks

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.codes)
        self.codes.update(zip(words, range(n, n + len(words)), strict=True))
        self.pool.append(ids)
        self.sizes.append(sizes)

    def _learn(self, words: list[str], letters: bool) -> None:
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            if letters:
                ids = np.array(self.light.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) == len(part):  # else some token looks like a word's end within one
                    self._add(part, ids, np.diff(ends, prepend=0))
                    continue
            each = [self._plain(w) for w in part]
            self._add(part, np.concatenate(each), np.array([len(e) for e in each]))

    def _code(self, words: pa.Array, letters: pa.Array | None) -> np.ndarray:
        """The code of each word; the new ones are learnt."""
        known = words.dictionary_encode()
        each = known.dictionary.to_pylist()
        if fresh := [w for w, c in zip(each, map(self.codes.get, each), strict=True) if c is None]:
            if letters is None:
                self._learn(fresh, False)
            else:
                is_plain = pc.match_substring_regex(pa.array(fresh, pa.string()), _PLAIN).to_numpy(zero_copy_only=False)
                self._learn([w for w, p in zip(fresh, is_plain.tolist(), strict=True) if p], True)
                self._learn([w for w, p in zip(fresh, is_plain.tolist(), strict=True) if not p], False)
        return np.fromiter(map(self.codes.__getitem__, each), np.int64, len(each))[known.indices.to_numpy()]

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts in a row, each closed by end, and where each text begins, one more for the last end."""
        if len(self.codes) > _CACHE_WORDS:
            self._forget()
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.apart) if self.by_word else pa.array([True] * len(texts))
        lists = pc.utf8_split_whitespace(pc.if_else(whole, "", texts))
        words = lists.flatten().dictionary_encode()
        number, words = words.indices.to_numpy().astype(np.int64), words.dictionary
        core = pc.utf8_rtrim(words, characters=_END_MARKS)
        letters = pc.match_substring_regex(core, _PLAIN)
        marked = pc.and_(letters, pc.not_equal(core, words))
        marks = pc.extract_regex(words.filter(marked), pattern="(?P<m>[.,!?;:%&$#*|-]+)$").field("m")
        main = self._code(pc.if_else(letters, pc.utf8_lower(core), words), letters)
        after = np.zeros(len(words), np.int64)
        after[marked.to_numpy(zero_copy_only=False)] = self._code(marks, None)
        pair = np.stack([main[number], after[number]], axis=1).ravel()
        # texts taken whole, then ends, stand behind each text's words
        alone = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        apart = [*(self._plain(texts[int(i)].as_py()) for i in alone), np.array([end], "<u4")]
        n = len(self.codes)
        ends = 2 * (lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py())
        codes = np.insert(pair, np.concatenate((ends[alone + 1], ends[1:])), np.concatenate((n + np.arange(len(alone)), np.full(len(texts), n + len(alone)))))
        per_text = np.diff(ends) + 1 + np.isin(np.arange(len(texts)), alone)
        self.pool, self.sizes = [np.concatenate(self.pool)], [np.concatenate(self.sizes)]
        pool, sizes = np.concatenate([*self.pool, *apart]), np.concatenate([*self.sizes, [len(x) for x in apart]])
        length = sizes[codes]
        upto = np.concatenate(([0], np.cumsum(length)))
        first = np.cumsum(sizes) - sizes
        ids = pool[np.repeat(first[codes] - upto[:-1], length) + np.arange(upto[-1])]
        return ids, upto[np.concatenate(([0], np.cumsum(per_text)))]


_IDS: dict[str, Ids] = {}


def token_pieces(docs: DataFrame, keys: list[str], tokenizer: str | None = None, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """keys, piece, start, length and ids (little-endian 32-bit) of each document's pieces.

    A document is its token ids, then id 1; only one that is longer than the capacity is cut, into pieces of that many
    ids, the last maybe shorter. Null texts are empty and so one id long. tokenizer: a path that every executor has; by
    default that of the installed package of public tokenizers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        if path not in _IDS:
            _IDS[path] = Ids(path)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                ids, ends = _IDS[path](part.column("pack_text"), END_ID)
                total = np.diff(ends)
                n = -(-total // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(total[row] - start, capacity)
                cuts = pa.py_buffer(np.append(ends[row] + start, ends[-1]) * 4)
                raw = pa.Array.from_buffers(pa.large_binary(), len(row), [None, cuts, pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(row)) for k in keys), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), raw], names=[*keys, "piece", "start", "length", "ids"])

    rows = docs.select(*keys, F.col(text).alias("pack_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, piece int, start bigint, length bigint, ids binary".lstrip(", "))


def _knapsack(value: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each size, any number of times, for the largest value within the capacity."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.arange(len(sizes))
    for c in range(int(sizes.min()), capacity + 1):
        ok = sizes <= c
        gain = best[c - sizes[ok]] + value[ok]
        i = int(gain.argmax())
        if gain[i] > best[c - 1] + 1e-12:
            best[c], last[c] = gain[i], order[ok][i]
        else:
            best[c], last[c] = best[c - 1], -2
    count, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0 and last[c] != -1:
        if last[c] == -2:
            c -= 1
        else:
            count[last[c]] += 1
            c -= int(sizes[last[c]])
    return count


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 120) -> list[tuple[np.ndarray, int]]:
    """Patterns of sizes and how often to use each: the linear programme of few sizes by column generation, rounded down."""
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.linalg.inv(basis)
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        new = _knapsack(np.maximum(dual, 0), sizes, capacity).astype(float)
        if dual @ new <= 1 + 1e-6:
            break
        x, step = inverse @ need, inverse @ new
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = new
        inverse = np.linalg.inv(basis)
    x = np.floor(inverse @ need + 1e-9)
    return [(basis[:, j].astype(np.int64), int(x[j])) for j in range(m) if x[j] > 0]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) for lengths in falling order, each from 1 to capacity."""
    n = len(lengths)
    seq, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    n_large = int((lengths > capacity // SMALL).sum())
    used: list[int] = []
    if n_large:
        groups = [g for g in np.array_split(np.arange(n_large), min(SIZES, n_large)) if len(g)]
        sizes = np.array([lengths[g[0]] for g in groups])  # the largest of each group stands for all
        distinct, of = np.unique(sizes, return_inverse=True)
        stock: list[list[int]] = [[] for _ in distinct]
        for g, d in zip(groups, of, strict=True):
            stock[d] += g.tolist()
        stock = [sorted(s, reverse=True) for s in stock]  # taken from the end: largest first
        for pattern, times in configurations(distinct, np.array([len(s) for s in stock], float), capacity):
            for _ in range(times):
                items = [stock[d].pop() for d in np.repeat(np.arange(len(distinct)), pattern) if stock[d]]
                if not items:
                    break
                at = 0
                for i in items:
                    seq[i], offset[i] = len(used), at
                    at += int(lengths[i])
                used.append(at)
    free: dict[int, list[int]] = {}
    mask = 0
    for b, u in enumerate(used):
        if u < capacity:
            free.setdefault(capacity - u, []).append(b)
            mask |= 1 << (capacity - u)
    for i in np.flatnonzero(seq < 0).tolist():  # the rest, still in falling order: the fullest sequence with room
        size = int(lengths[i])
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            b, room = len(used), capacity
            used.append(0)
        seq[i], offset[i] = b, used[b]
        used[b] += size
        if room > size:
            if not free.get(room - size):
                mask |= 1 << (room - size)
            free.setdefault(room - size, []).append(b)
    return seq, offset


def plan_packing(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(uid, sequence_id, offset) for rows (uid, length, tie): tie, a hash of what a piece is, orders equal lengths."""
    n = max(1, -(-pieces.count() // group))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "tie"], ascending=[False, True])
        seq, offset = pack_lengths(rows["length"].to_numpy(), capacity)
        return pd.DataFrame({"uid": rows["uid"].to_numpy(), "sequence_id": (int(rows["part"].iloc[0]) << 32) + seq, "offset": offset})

    dealt = pieces.select("uid", "length", "tie", F.pmod(F.xxhash64("tie", "uid"), F.lit(n)).alias("part"))
    return dealt.groupBy("part").applyInPandas(pack, "uid bigint, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, keys: list[str] = ("doc_id",), capacity: int = CAPACITY, group: int = GROUP, tokenizer: str | None = None) -> DataFrame:
    """keys, piece, start, length, ids, ids_crc32, sequence_id and offset of each piece: as few sequences as best fit finds.

    Every row of docs is packed, repeated ones as often as they come; null texts are empty and take one id; no rows
    give no pieces. Offsets in a sequence are gapless from 0. Other columns of docs are not read.
    """
    uid, tie = "uid", F.xxhash64(*keys, "piece", "length")
    tokens = token_pieces(docs, list(keys), tokenizer, capacity).withColumns({"ids_crc32": F.crc32("ids"), uid: F.monotonically_increasing_id()})
    tokens = stage_table(tokens, "tokens")  # whoever drops ids from the result reads and moves none
    plan = stage_table(plan_packing(tokens.select(uid, "length", tie.alias("tie")), capacity, group), "plan")
    return tokens.join(plan, uid).drop(uid)
