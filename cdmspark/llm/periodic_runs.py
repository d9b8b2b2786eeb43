"""Periodic runs of words: a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q and at least max(``LEAST``, 2q) words
that no neighbouring word extends.

1. Windows. A run of period q repeats every ``GRAM``-gram of its words after the first q at distance
   q, so its repeating grams are consecutive, at least q - GRAM + 1 of them, and each occurs again
   within q words. Sorted gram hashes of a batch give every gram's latest earlier place; grams that
   come again too far off for the stretch they lie in are struck out until none is left. What stays
   are windows of words that hold every run whole; equal hashes of unequal grams only add words.
2. Automaton. The words of a window are appended to a suffix automaton. Its suffix links form a
   tree, cut into paths of states whose latest occurrence ends at the same word (one colour a path).
   Appending a word accesses the path from the new state to the root: every piece it passes has one
   colour, the previous end, and the deepest state on it gives the longest suffix that ended there.
   A previous end no farther off than that length is a square of that period; no shorter period is
   possible, as the previous end is the latest one. The accessed path then gets the new end as its
   colour; what hangs below a piece is cut off and keeps its own.
   Paths are lists in order of length; a cut or a join moves and renames the smaller part.
3. Runs. A square extends to its run over the whole text; later squares of it are skipped by the end
   of the latest run of that period.

Collapsing drops every word that some run contains after that run's first q words.

Defined results: a null or empty text has no words and no run; rows repeat as they do in the input;
a text of any length is handled whole, about ``WORDS`` words of shorter texts at a time; words are
the stretches without ASCII white space, compared byte by byte; an empty table gives an empty
result. Other columns are not looked at. A null doc_id counts as the empty text in the query's rule
for rewritten documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, whole_text

LEAST, GRAM, WORDS = 12, 6, 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)

RESULT = pa.struct([("n_words", pa.int64()),
                    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                    ("collapsed", pa.string())])
RESULT_DDL = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def windows(codes: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [a, b) of the concatenated word hashes ``codes`` (texts end before ``ends``) that hold
    every run; they are disjoint, in order, and each lies in one text."""
    n = len(codes)
    if n < LEAST:
        return []
    first = np.r_[0, ends[:-1]]
    size = ends - first
    text_first, text_end = np.repeat(first, size), np.repeat(ends, size)
    with np.errstate(over="ignore"):
        gram = np.zeros(n - GRAM + 1, np.uint64)
        for k in range(GRAM):
            gram = gram * _MIX + codes[k:n - GRAM + 1 + k].view(np.uint64)
        gram ^= gram >> np.uint64(29)
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    before = np.full(len(gram), -1)
    before[order[1:][same]] = order[:-1][same]
    at = np.flatnonzero((before >= text_first[:len(gram)]) & (np.arange(len(gram)) + GRAM <= text_end[:len(gram)]))
    far = at - before[at]
    while True:
        if not len(at):
            return []
        # stretches of consecutive places in one text
        cut = np.flatnonzero((np.diff(at) != 1) | (text_first[at[1:]] != text_first[at[:-1]])) + 1
        head, tail = np.r_[0, cut], np.r_[cut, len(at)]
        room = tail - head + GRAM - 1
        keep = far <= np.repeat(room, tail - head)
        if keep.all():
            break
        at, far = at[keep], far[keep]
    out: list[tuple[int, int]] = []
    for x, y, m in zip(at[head].tolist(), at[tail - 1].tolist(), room.tolist()):
        lo, hi = max(x - m, int(text_first[x])), y + GRAM
        while out and lo < out[-1][1]:
            a, b = out.pop()
            lo, hi = min(lo, a), max(hi, b)
        out.append((lo, hi))
    return out


class PrefixAutomaton:
    """The suffix automaton of the words appended so far, its suffix-link tree cut into paths by the
    latest end of each state."""

    def __init__(self):
        self.length, self.link = [0], [-1]
        self.char, self.to, self.more = [-1], [0], {}
        self.path, self.paths, self.end, self.free = [0], [[0]], [-1], []
        self.last, self.size = 0, 0

    def _next(self, p: int, c: int) -> int:
        """Where the transition of state ``p`` on ``c`` leads; 0 (the root has no incoming ones) for none."""
        if self.char[p] == c:
            return self.to[p]
        m = self.more.get(p)
        return m.get(c, 0) if m else 0

    def _set(self, p: int, c: int, q: int) -> None:
        if self.char[p] == c or self.char[p] < 0:
            self.char[p], self.to[p] = c, q
        else:
            self.more.setdefault(p, {})[c] = q

    def _place(self, path: list[int], u: int) -> int:
        if len(path) < 16:
            return path.index(u)
        return bisect_left(path, self.length[u], key=self.length.__getitem__)

    def append(self, c: int) -> list[tuple[int, int]]:
        """Append word ``c``; the (previous end, longest suffix that ended there) of every colour on
        the new state's path, longest suffix first."""
        length, link = self.length, self.link
        cur, p = len(length), self.last
        i, self.size, self.last = self.size, self.size + 1, cur
        length.append(i + 1)
        link.append(0)
        self.char.append(-1)
        self.to.append(0)
        self.path.append(-1)
        while p >= 0:
            q = self._next(p, c)
            if q:
                break
            self._set(p, c, cur)
            p = link[p]
        if p >= 0:
            link[cur] = q if length[p] + 1 == length[q] else self._split(p, c, q)
        return self._access(cur, i)

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the shorter words of ``q``, above it on its path: it ended where ``q`` did."""
        u = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.char.append(self.char[q])
        self.to.append(self.to[q])
        if q in self.more:
            self.more[u] = dict(self.more[q])
        self.link[q] = u
        path = self.paths[self.path[q]]
        path.insert(self._place(path, q), u)
        self.path.append(self.path[q])
        while p >= 0 and self._next(p, c) == q:
            self._set(p, c, u)
            p = self.link[p]
        return u

    def _new_path(self, states: list[int], end: int) -> int:
        if self.free:
            k = self.free.pop()
            self.paths[k], self.end[k] = states, end
        else:
            k = len(self.paths)
            self.paths.append(states)
            self.end.append(end)
        for x in states:
            self.path[x] = k
        return k

    def _access(self, cur: int, i: int) -> list[tuple[int, int]]:
        path, paths = self.path, self.paths
        got = []
        mine = self._new_path([cur], i)
        u = self.link[cur]
        while u >= 0:
            k = path[u]
            states = paths[k]
            got.append((self.end[k], self.length[u]))
            up = self._place(states, u) + 1
            if 2 * up <= len(states):  # the lower part keeps the list
                upper = states[:up]
                del states[:up]
                for x in upper:
                    path[x] = mine
                paths[mine][:0] = upper
            else:
                if up < len(states):
                    lower = states[up:]
                    del states[up:]
                    self._new_path(lower, self.end[k])
                below = paths[mine]
                if len(below) <= len(states):
                    for x in below:
                        path[x] = k
                    states += below
                    paths[mine] = []
                    self.free.append(mine)
                    mine = k
                else:
                    for x in states:
                        path[x] = mine
                    below[:0] = states
                    paths[k] = []
                    self.free.append(k)
            u = self.link[paths[mine][0]]
        self.end[mine] = i
        return got


def runs_within(words: list, a: int, b: int, found: set[tuple[int, int, int]]) -> None:
    """Add the runs (start, length, period) that squares within words a..b-1 lead to."""
    codes: dict = {}
    automaton, done, n = PrefixAutomaton(), {}, len(words)
    for i in range(a, b):
        for end, suffix in automaton.append(codes.setdefault(words[i], len(codes))):
            q = i - a - end
            if suffix < q or done.get(q, -1) >= i:
                continue
            start, stop = i - q - suffix + 1, i + 1
            while stop < n and words[stop] == words[stop - q]:
                stop += 1
            while start > 0 and words[start - 1] == words[start - 1 + q]:
                start -= 1
            done[q] = stop - 1
            if stop - start >= max(LEAST, 2 * q):
                found.add((start, stop - start, q))


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text's words by start, then period."""
    ends = np.cumsum([len(t) for t in texts])
    codes = np.fromiter((hash(w) for t in texts for w in t), np.int64, int(ends[-1]) if len(ends) else 0)
    out: list[set] = [set() for _ in texts]
    for a, b in windows(codes, ends):
        k = int(np.searchsorted(ends, a, "right"))
        base = int(ends[k]) - len(texts[k])
        runs_within(texts[k], a - base, b - base, out[k])
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q:start + length] = False
    return b" ".join(w for w, k in zip(words, keep.tolist()) if k)


def _batch(texts: pa.Array) -> pa.Array:
    split = [t.split() for t in texts.cast(pa.binary()).to_pylist()]  # ASCII white space
    runs: list[list[tuple[int, int, int]]] = []
    group: list[list[bytes]] = []
    held = 0
    for t in split:
        if held and held + len(t) > WORDS:
            runs += runs_of(group)
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        runs += runs_of(group)
    flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
    spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
    offsets = pa.array(np.cumsum([0] + [len(r) for r in runs]), pa.int32())
    return pa.StructArray.from_arrays(
        [pa.array([len(t) for t in split], pa.int64()), pa.ListArray.from_arrays(offsets, spans),
         pa.array([collapse(t, r) for t, r in zip(split, runs)], pa.binary()).cast(pa.string())],
        fields=list(RESULT))


def periodic_runs(text: Column) -> Column:
    """Per text a struct: n_words, runs (start, length, period; by start, then period) and collapsed,
    the kept words joined by one space."""
    @F.arrow_udf(RESULT_DDL)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _batch(texts)

    return run(F.coalesce(text.cast("string"), F.lit("")))


def rewritten(key: str, text: bytes) -> bytes:
    """The contract's text: where h = crc32(key) is divisible by 10, each word i from a on becomes word
    a + (i - a) % p, with g = h div 10, a = g % n and p = 1 + (n - a) div (3 + g % 8)."""
    h = zlib.crc32(key.encode())
    words = [] if h % 10 else text.split()
    if not words:
        return text
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a])


def with_periodic_tail(text: Column, key: Column) -> Column:
    """``rewritten`` over columns."""
    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, keys in batches:
            raw = map(rewritten, keys.to_pylist(), texts.cast(pa.binary()).to_pylist())
            yield pa.array(list(raw), pa.binary()).cast(pa.string())

    return run(text, F.coalesce(key.cast("string"), F.lit("")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = docs.select("doc_id", periodic_runs(with_periodic_tail(whole_text(), F.col("doc_id"))).alias("r"))
    best = F.element_at(F.array_sort(F.transform("r.runs", lambda x: F.struct(
        (-x["length"]).alias("l"), x["start"].alias("start"), x["period"].alias("period")))), 1)
    listed = F.array_join(F.transform("r.runs", lambda x: F.concat_ws(
        ",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string"))), "\n")
    some = F.size("r.runs") > 0
    return (found.withColumn("best", F.when(some, best))
            .select("doc_id", F.size("r.runs").cast("bigint").alias("n_runs"),
                    F.col("best.start").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.period").alias("period"),
                    F.floor(F.lit(1000) * -F.col("best.l") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
                    F.sha2(F.when(some, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
                    F.sha2(F.col("r.collapsed"), 256).alias("collapsed_sha256")))
