import random
import zlib

from pyspark.sql import functions as F

from cdmspark.llm.common import table, whole_text
from cdmspark.llm.toxicity import Lexicon, context, fit, op1_toxicity, rejected, score, training_rows
from tests.conftest import SF_MID


def distance(a, b):
    """Edits with a swap of neighbours as one, by the whole dynamic programme."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_distances():
    """Closeness of random words to words and stems, by the whole dynamic programme."""
    rnd = random.Random(7)
    terms = [("idiot", False), ("scum", False), ("worthless", False), ("dumb", True), ("nitwitte", True), ("pathetica", True)]
    lex = Lexicon(terms)
    words = [t for t, _ in terms]
    for _ in range(3000):
        w = list(rnd.choice(terms)[0] + rnd.choice(["", "", "er", "s"]))
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(w) + 1)
            if rnd.random() < 0.4:
                w[k:k + 2] = w[k:k + 2][::-1]
            else:
                w[k:k + rnd.randrange(2)] = rnd.choice(["", "x", "i", "t"])
        words.append("".join(w))
    for w in words:
        want = 0.0
        for term, stem in terms:
            d = min(distance(w[:k], term) for k in range(len(w) + 1)) if stem else distance(w, term)
            if d <= lex.edits(term, stem):
                want = max(want, 1 - 0.25 * d)
        assert lex.match(w) == want, w


def test_swaps_short_terms_and_very_long_words():
    long = "abcdefghijk" * 6
    lex = Lexicon([("idiot", False), ("moron", False), ("pathetic", False), ("scum", False), (long, False), (long + "xyz", False)])
    for w in ("idoit", "mroon", "pahtetic", "scuum", "scmu"):
        assert lex.match(w) == 0.75, w
    assert lex.match(long) == lex.match(long + "xyz") == 1 and lex.match(long + "xy") == 0.75 and lex.match("q" * 100_000) == 0


def test_context_separates_quotation_from_abuse():
    def weight(text, word):
        a = text.index(word)
        return context(text, a, a + len(word), text[:a].split()[-8:], text[a + len(word):].split()[:8])

    plain = weight("what an idiot this is", "idiot")
    assert weight("you are an idiot", "idiot") > plain > weight('she wrote the word "idiot" in it', "idiot")
    assert weight('they said "what an idiot this is" loudly', "idiot") < plain


def corpus(n=400):
    rnd = random.Random(11)
    rows = []
    for i in range(n):
        words = [rnd.choice("abcdefghij") + rnd.choice(["ron", "lit", "mas", "tep"]) + rnd.choice("aeiou") for _ in range(60)]
        toxic = int(i % 3 == 0)
        if toxic:
            for _ in range(3):
                words[rnd.randrange(60)] = rnd.choice(["blockhead", "vermin", "zurk" + rnd.choice(["a", "en", "ish", "o"])])
        rows.append((i, " ".join(words), toxic))
    return rows


def test_learned_terms_misspellings_and_odd_rows(spark):
    rows = corpus()
    odd = [(None, "vermin vermin vermin vermin"), (1000, None), (1001, ""), (1002, "xx " * 200_000 + "vermin vermin blockhead zurkopp"),
           (1003, "you blokchead, you blockhed, verminn vermim vermi and blockheaad"), (1003, "aron lita"),
           (1004, 'the dictionary lists the word "vermin" as a term')]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(*r, 0.5) for r in odd], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (3, None), (5000, 1)], "doc_id long, toxic int")
    model = fit(training_rows(docs, labels))
    assert {t for t, _ in model.terms} >= {"blockhead", "vermin"} and any(s and "zurkxyz".startswith(t) for t, s in model.terms)
    got = docs.select("doc_id", "text", score(whole_text(), model).alias("p")).collect()
    p = {(r.doc_id, r.text): r.p for r in got}
    assert len(got) == len(rows) + len(odd) and all(0 <= x <= 1 for x in p.values())
    assert all((p[i, t] >= 0.5) == bool(x) for i, t, x in rows)
    assert p[None, odd[0][1]] > 0.5 < p[1002, odd[3][1]] and p[1003, odd[4][1]] > 0.5
    assert p[1000, None] == p[1001, ""] < 0.5 and p[1003, "aron lita"] < 0.5 and p[1004, odd[-1][1]] < 0.5
    for few in (labels.limit(0), labels.filter("toxic = 0")):
        assert {round(r.p, 6) for r in docs.select(score(whole_text(), fit(training_rows(docs, few))).alias("p")).collect()} <= {0.0, 1e-9}
    assert docs.limit(0).select(score(F.col("text"), model)).count() == 0
    # with labels of one kind, or none learned from, nothing is rejected, whatever the share of toxic ones
    for few in (labels.filter("toxic = 1"), labels.limit(0), labels.filter("doc_id < 3").replace(0, 1, "toxic")):
        assert docs.filter(rejected(whole_text(), fit(training_rows(docs, few)))).count() == 0
    assert {r.doc_id for r in docs.filter(rejected(whole_text(), model)).collect()} >= {i for i, _, x in rows if x}


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in table(spark, SF_MID, "labels").collect()}
    rows = op1_toxicity(spark, SF_MID).collect()
    assert len(rows) == table(spark, SF_MID, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)
