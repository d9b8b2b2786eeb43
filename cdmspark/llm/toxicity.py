"""Toxicity: Levenshtein automata intersected with a lexicon trie, hits weighed by their context.

1. Lexicon. Of the labelled training rows (about ``TRAIN_ROWS`` of them at most, chosen by a hash
   of doc_id), every word and every stem of 4 to ``STEM`` letters is counted by the distinct words
   before it, in toxic and in other documents; copies of one document so count once. A term enters
   if its odds are ``ODDS`` times those of other terms and its G2 statistic exceeds what the best of
   all candidates reaches by chance. A stem that only repeats a longer term gives way to it. At most
   ``TERMS`` terms, the strongest ones.
2. Matching. The terms form a trie. The automaton of a word's Levenshtein neighbourhood walks it:
   one edit from ``EDIT_LEN`` letters on, two from ``EDIT2_LEN`` on; a swap of neighbours is one edit. Every distinct word is matched
   once per worker (a table of ``WORDS_KEPT`` words, emptied when full); a word without any piece of a term where that piece can stand is skipped, which
   loses nothing (with e edits, one of e + 1 pieces is intact). Misspellings that occur in training
   documents without toxic label are words of their own and do not count.
3. Context. A hit counts for its closeness to the term times a weight of the window around it:
   quotation marks around it and words of reporting lower it, direct address raises it.
4. Score. A logistic regression on three sums of hits (exact, misspelled, all) is fitted on the
   training rows by Newton steps; the score is its probability.

Inputs of a score are the text alone. Defined results: a null text counts as empty and has the
score of a text without hits; ids repeat as rows repeat; without usable labels, or with labels of
one kind only, every score is the share of toxic labels (0 without labels). Empty tables give empty
results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, store, table, whole_text

TRAIN_ROWS, TERMS, STEM, ODDS = 20_000, 5_000, 10, 20.0
PAIRS, WORDS_KEPT = 200_000, 200_000
EDIT_LEN, EDIT2_LEN = 4, 9
WINDOW = 8
WORD = re.compile(r"[^\W_]+(?:[@$!*'’][^\W_]+)*")
# Quotation marks, words of reporting and of direct address.
QUOTES = "\"“”„«»‹›‘"
REPORT = frozenset("""said says say saying wrote writes called calls calling quote quoted quotes term word slur insult
 sagte schrieb nannte zitat wort begriff beleidigung dit disait écrit appelé citation mot terme insulte
 dijo dice escribió llamó cita palabra término insulto""".split())
ADDRESS = frozenset("you your youre yourself du dich dein ihr euch tu te toi ton vous votre tú ti usted vosotros".split())


def swapped(term: str, cuts: list[int]) -> str:
    """``term`` with the letters on both sides of each cut in each other's place."""
    letters = list(term)
    for x in cuts:
        letters[x - 1], letters[x] = letters[x], letters[x - 1]
    return "".join(letters)


class Lexicon:
    """Terms in a trie; ``stem`` terms match any word that begins with them."""

    def __init__(self, terms: list[tuple[str, bool]], clean: frozenset[str] = frozenset()):
        self.terms, self.clean = terms, clean
        self.trie: dict = {}
        for term, stem in terms:
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = node.get("", ()) + ((term, stem),)
        self.hint = self._hint()
        self.seen: dict[str, float] = {}

    @staticmethod
    def edits(term: str, stem: bool) -> int:
        """Edits that still count; a stem leaves the rest of a word open, so it needs more letters."""
        return (len(term) >= EDIT_LEN + 3 * stem) + (len(term) >= EDIT2_LEN + 3 * stem)

    def _hint(self) -> re.Pattern | None:
        """Matches every word that can be within reach of a term."""
        places: dict[tuple[int, int], set[str]] = {}
        for term, stem in self.terms:
            e = self.edits(term, stem)
            cut = [len(term) * i // (e + 1) for i in range(e + 2)]
            for a, b in zip(cut, cut[1:]):
                places.setdefault((max(0, a - e), a + e), set()).add(term[a:b])
            # a swap of the letters on both sides of a cut breaks two pieces at once
            inner = cut[1:-1]
            for a, x, b in zip(cut, inner, cut[2:]):
                places.setdefault((max(0, a - e), a + e), set()).add(swapped(term, [x])[a:b])
            if len(inner) > 1:
                places.setdefault((0, 0), set()).add(swapped(term, inner))
        if not places:
            return None
        return re.compile("|".join(
            "^.{%d,%d}(?:%s)" % (lo, hi, "|".join(map(re.escape, sorted(p)))) for (lo, hi), p in sorted(places.items())))

    def _walk(self, word: str) -> float:
        """Closeness (1 exact, less by edits, 0 none) of the best term, by stepping the automaton of
        ``word`` along the trie. A state is the set of (letters of the word read, edits made); -1 - i
        letters stand for i and the second half of a swap still to come."""
        most, n = 2, len(word)

        def closed(state: set) -> set:
            todo = list(state)
            while todo:  # a letter of the word that the term lacks
                i, e = todo.pop()
                if 0 <= i < n and e < most and (i + 1, e + 1) not in state:
                    state.add((i + 1, e + 1))
                    todo.append((i + 1, e + 1))
            return state

        best, todo = 0.0, [(self.trie, closed({(0, 0)}))]
        while todo:
            node, state = todo.pop()
            for term, stem in node.get("", ()):
                ends = [e for i, e in state if i == n or stem and i >= 0]
                if ends and min(ends) <= self.edits(term, stem):
                    best = max(best, 1.0 - 0.25 * min(ends) if min(ends) else 1.0)
            for c, child in node.items():
                if c == "":
                    continue
                step = set()
                for i, e in state:
                    if i < 0:
                        if word[-1 - i] == c:
                            step.add((1 - i, e))
                        continue
                    if i < n and word[i] == c:
                        step.add((i + 1, e))
                    elif e < most:
                        step.add((i, e + 1))
                        if i < n:
                            step.add((i + 1, e + 1))
                        if i + 1 < n and word[i + 1] == c:
                            step.add((-1 - i, e + 1))
                if step:
                    todo.append((child, closed(step)))
        return best

    def match(self, word: str) -> float:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) > WORDS_KEPT:
                self.seen.clear()
            got = self._walk(word) if self.hint is not None and self.hint.search(word) else 0.0
            if 0 < got < 1 and word in self.clean:
                got = 0.0
            self.seen[word] = got
        return got


def context(text: str, a: int, b: int, before: list[str], after: list[str]) -> float:
    """Weight of a hit at text[a:b]: 1 plain, less in quotation or report, more in direct address."""
    left, right = text[max(0, a - 60):a], text[b:b + 60]
    quoted = any(c in left for c in QUOTES) and any(c in right for c in QUOTES)
    close = a > 0 and b < len(text) and text[a - 1] in QUOTES + "'" and text[b] in QUOTES + "'’"
    around = {*before, *after}
    z = 2.0 + bool(around & ADDRESS) - 1.5 * bool(around & REPORT) - 1.0 * quoted - 1.5 * close
    return 1 / (1 + math.exp(-z)) / (1 / (1 + math.exp(-2.0)))


def features(text: str, lexicon: Lexicon) -> tuple[float, float, float]:
    """Of exact and of misspelled hits, each weighed by context: both sums up to 1, the log of all."""
    low = text.lower()
    words = WORD.findall(low)
    match = lexicon.match
    if not any(match(w) for w in set(words)):
        return 0.0, 0.0, 0.0
    exact = fuzzy = 0.0
    spans = list(WORD.finditer(low))
    for k, m in enumerate(spans):
        got = match(words[k])
        if got:
            weight = got * context(low, m.start(), m.end(), words[max(0, k - WINDOW):k], words[k + 1:k + 1 + WINDOW])
            if got == 1:
                exact += weight
            else:
                fuzzy += weight
    return min(1.0, exact), min(1.0, fuzzy), math.log1p(exact + fuzzy)


class Model:
    """A lexicon and the weights of the regression; plain data, a few hundred kilobytes at most."""

    def __init__(self, terms: list[tuple[str, bool]], clean: frozenset[str], weights: list[float]):
        self.terms, self.clean, self.weights = terms, clean, weights

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """The score of a text under a model; the words met so far are kept."""

    def __init__(self, model: Model):
        self.lexicon, self.weights = Lexicon(model.terms, model.clean), model.weights

    def judge(self, text: str) -> tuple[float, bool]:
        """The score, and whether the text has any hit."""
        found = features(text, self.lexicon)
        z = self.weights[0] + sum(a * b for a, b in zip(self.weights[1:], found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), any(found)

    def __call__(self, text: str) -> float:
        return self.judge(text)[0]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, the word before it, toxic), each once for about ``PAIRS`` words of text."""
    schema = pa.schema([("word", pa.string()), ("before", pa.string()), ("toxic", pa.int32())])

    def batch(pairs: set) -> pa.RecordBatch:
        rows = list(pairs)
        return pa.RecordBatch.from_pydict({
            "word": [w for w, _, _ in rows], "before": [p for _, p, _ in rows], "toxic": [t for _, _, t in rows]}, schema=schema)

    pairs: set = set()
    for b in batches:
        for text, toxic in zip(b.column(0), b.column(1)):
            words, toxic = WORD.findall(text.as_py().lower()), toxic.as_py()
            pairs.update(zip(words, ["", *words], [toxic] * len(words)))
            if len(pairs) > PAIRS:
                yield batch(pairs)
                pairs = set()
    yield batch(pairs)


def learn_lexicon(train: DataFrame) -> list[tuple[str, bool]]:
    """Terms of the training rows (text, toxic)."""
    pairs = train.mapInArrow(_pairs, "word string, before string, toxic int").select(
        "word", F.xxhash64("before").alias("before"), "toxic").distinct()
    words = store(pairs.groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")), "words")
    total = words.agg(F.sum("pos"), F.sum("neg"), F.count("*")).first()
    if not total[0] or not total[1]:
        return []
    stems = words.filter(F.length("word") >= 4).select(F.explode(F.transform(
        F.sequence(F.lit(4), F.least(F.length("word"), F.lit(STEM))),
        lambda n: F.substring("word", F.lit(1), n))).alias("term"), "pos", "neg")
    stems = stems.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count("*").alias("n"))
    terms = words.select(F.col("word").alias("term"), "pos", "neg", F.lit(False).alias("stem")).unionByName(
        stems.filter("n > 1").select("term", "pos", "neg", F.lit(True).alias("stem")))
    p, n = F.col("pos"), F.col("neg")
    share = total[0] / (total[0] + total[1])

    def part(x: Column, rate: float) -> Column:
        return F.when(x > 0, x * F.log(x / ((p + n) * rate))).otherwise(0.0)

    g2 = 2 * (part(p, share) + part(n, 1 - share))
    odds = (p + 0.5) / (n + 0.5) * (total[1] / total[0])
    chance = 2 * math.log(max(2, total[2] * 4)) + 4
    strong = (terms.filter((p >= 4) & (odds >= ODDS) & (F.length("term") >= 3)).withColumn("g2", g2)
              .filter(F.col("g2") > chance).orderBy(F.desc("g2"), "term", "stem").limit(TERMS).collect())
    # longest first: a stem replaces the terms it covers if what it adds to them is as telling
    taken: dict[tuple[str, bool], tuple[int, int]] = {}
    for r in sorted(strong, key=lambda r: (-len(r["term"]), r["stem"], r["term"])):
        term, stem = r["term"], r["stem"]
        inside = [k for k in taken if k[0].startswith(term)] if stem else []
        more = [r["pos"] - sum(taken[k][0] for k in inside), r["neg"] - sum(taken[k][1] for k in inside)]
        telling = (more[0] + 0.5) / (more[1] + 0.5) * (total[1] / total[0]) >= ODDS
        if inside and not (len(inside) >= 3 and (telling or more == [0, 0])
                           or telling and more[0] >= max(4, 0.05 * r["pos"])):
            continue
        for k in inside:
            del taken[k]
        taken[term, stem] = (r["pos"], r["neg"])
    return sorted(taken)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> list[float]:
    """Newton steps; the weights of hits stay at 0 or more."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)) * len(x)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) * np.r_[0.0, w[1:]])
        w = w + step
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of labelled rows outside the held-out fold, about ``rows`` at most. Ids labelled
    twice count with the larger label; ids, a few bytes each, are what is broadcast."""
    ids = labels.select(F.col(id_col).cast("bigint").alias("__id"), F.col(label_col).cast("int").alias("toxic")).filter(
        (~held_out(F.col("__id"))) & F.col("toxic").isin(0, 1)).groupBy("__id").agg(F.max("toxic").alias("toxic"))
    n = ids.count()
    if n > rows:
        ids = ids.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 40)) < int((1 << 40) * rows / n))
    return docs.select(F.col(id_col).cast("bigint").alias("__id"), whole_text(text_col).alias("text")).join(
        F.broadcast(ids), "__id").select("text", "toxic", F.xxhash64("text").alias("order"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(train: DataFrame) -> Model:
    """Learn from rows (text, toxic, order); what reaches the driver is a bounded lexicon and three
    numbers for each of the bounded training rows."""
    train = store(train, "toxic-train")
    terms = learn_lexicon(train)
    draft = Lexicon(terms)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, rows = set(), []
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.append(features(text, draft))
                if not toxic:
                    near.update(w for w in WORD.findall(text.lower()) if 0 < draft.match(w) < 1)
            x = np.array(rows, float).reshape(-1, 3)
            yield pa.RecordBatch.from_pydict({
                "order": b.column(2), "toxic": b.column(1), "f0": x[:, 0], "f1": x[:, 1], "f2": x[:, 2],
                "clean": [sorted(near)] + [[]] * (len(rows) - 1) if rows else []},
                schema=pa.schema([("order", pa.int64()), ("toxic", pa.int32()), ("f0", pa.float64()),
                                  ("f1", pa.float64()), ("f2", pa.float64()), ("clean", pa.list_(pa.string()))]))

    got = train.mapInArrow(measure, "order bigint, toxic int, f0 double, f1 double, f2 double, clean array<string>").toPandas()
    got = got.sort_values(["order", "toxic"], kind="stable")
    y = got["toxic"].to_numpy(float)
    if not len(y) or not terms or y.min() == y.max():
        share = min(1 - 1e-9, max(1e-9, float(y.mean()) if len(y) else 0.0))
        return Model(terms, frozenset(), [math.log(share / (1 - share)), 0.0, 0.0, 0.0])
    clean = frozenset(w for ws in got["clean"] for w in ws)
    x = got[["f0", "f1", "f2"]].to_numpy(float)
    w = _logistic(x[:, [0, 2]], y)
    # A misspelled hit weighs as an exact one of the same closeness; labels rarely have any to learn from.
    return Model(terms, clean, [w[0], w[1], w[1], w[2]])


def score(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for texts in batches:
            yield pd.Series([scorer(t) for t in texts], dtype="float64")

    return run(text)


def rejected(text: Column, model: Model) -> Column:
    """Whether the model finds a hit in the text and scores it 0.5 or more. A text without any hit is never
    rejected, whatever share of the labels is toxic and even where no term was learned."""
    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for texts in batches:
            yield pd.Series([p >= 0.5 and hit for p, hit in map(scorer.judge, texts)], dtype="bool")

    return run(text)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                         score(whole_text(), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
