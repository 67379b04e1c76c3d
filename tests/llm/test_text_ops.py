"""Operators over texts against brute force, with nulls, empty and long texts, repeats, empty tables, clashing names."""

import collections
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalog_audit.llm import exact_dedup, lm_score, mixing, near_dedup, perplexity, quality_rules
from catalog_audit.llm.components import components
from catalog_audit.llm.text import slices, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, counts int, kept boolean"
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def docs(frame, texts, **more):
    return frame(DOCS, [(i, t, more.get("lang", "en"), more.get("source", "s"), len(t or ""), "r", 1, True) for i, t in texts])


def corpus(n=120, seed=3):
    """Texts with exact and near copies, repeats, null, empty, blank and long ones."""
    rng = np.random.default_rng(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(5, 90)))) for _ in range(n)]
    for i in range(0, n, 6):
        w = texts[i].split()
        w[len(w) // 2] = "changed"
        texts.append("  " + " ".join(w) + "\n")
        texts.append(texts[i].replace(" ", " \t", 3).upper())
    texts += [None, "", " \n ", None, "one", "ONE", "one ", "w1 w2", "x" * 5000, " ".join(rng.choice(vocabulary, 6000))]
    return list(enumerate(texts))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=12))
def test_words(texts):
    got = []
    for _, _, data, bounds in slices(pa.array(texts, pa.string()), limit=16):
        w = words(data, bounds, lower=True)
        h = w.hashes()
        for d in range(len(bounds) - 1):
            span = range(w.docs[d], w.docs[d + 1])
            got.append([(bytes(w.data[w.start[k]:w.end[k]]), int(h[k])) for k in span])
    want = [(t or "").encode().lower().split() for t in texts]
    assert [[b for b, _ in d] for d in got] == want
    names = {}
    for b, h in (x for d in got for x in d):
        assert names.setdefault(b, h) == h
    assert len(set(names.values())) == len(names)


def brute_counts(text):
    text = text or ""
    w = [x for x in SPACES.split(text) if x]
    lines = [x for x in text.split("\n") if SPACES.sub("", x)]
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    many = {g for g, n in collections.Counter(grams).items() if n > 1}
    cover = {i + k for i, g in enumerate(grams) if g in many for k in range(8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))


def test_quality_counts(frame):
    rows = corpus() + [(900, "a b c d e f g h " * 5), (901, "é ü* #\nx y\nx y\n\nx y\r\n"), (902, "same\nsame\n same"), (903, "z\x0bz\x0cz\x85z")]
    got = quality_rules.judge_quality(docs(frame, rows)).select("row.doc_id", *[F.col("counts")[c].alias(c) for c in quality_rules.COUNTS[:5]], "base_failed", "kept").collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute_counts(dict(rows)[r["doc_id"]])
        assert tuple(r[1:6]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_thresholds_follow_their_group(frame):
    plain = "one two three four five six seven eight nine ten " * 2
    clean = [(i, " ".join(f"word{i}x{k}" for k in range(40)), "en", "a", 0, "r", 1, True) for i in range(40)]
    junk = [(100, " ".join(f"w{k}*$" for k in range(40)), "en", "a", 0, "r", 1, True)]
    other = [(200 + i, " ".join(f"v{i}x{k}*$" for k in range(40)), None, None, 0, "r", 1, True) for i in range(40)]
    out = quality_rules.filter_quality(frame(DOCS, clean + junk + other))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    kept = {r["doc_id"] for r in out.collect()}
    assert kept == {i for i, *_ in clean} | {i for i, *_ in other}  # what is usual in a source is no outlier there
    assert quality_rules.judge_quality(frame(DOCS, [])).count() == 0
    assert not quality_rules.judge_quality(docs(frame, [(1, plain * 3)])).first()["kept"]


def test_quality_fences_bind(frame):
    def text(i, size, n=40):
        w = [(f"q{k:02}" + "abcdefghijkl")[:size + (i + k) % 2 * (i % 3)] for k in range(n)]
        return " ".join([w[0].upper() if i % 2 else w[0], *w[1:]])

    def table(lang, source, texts, first):
        return [(first + i, t, lang, source, 0, "r", 1, True) for i, t in enumerate(texts)]

    usual = table("en", "a", [text(i, 5) for i in range(60)], 0)
    far = table("en", "a", [text(900, 12), " ".join(w.upper() if k % 2 else w for k, w in enumerate(text(0, 5).split()))], 100)  # long words; capitals
    hot = table("en", "b", [text(i, 5) for i in range(60)] + ["ABCDE F%dGHI JKLMN " % i + " ".join(f"{chr(65 + k)}WXYZ" for k in range(26)) for i in range(30)], 200)
    lone = table("en", "c", [" ".join(f"w{k}*$" for k in range(40))], 300)  # a group of one, judged by its language
    none = table("xx", "d", [" \n", None], 400)
    reason = {r["doc_id"]: r["reason"] for r in quality_rules.judge_quality(frame(DOCS, usual + far + hot + lone + none)).select("row.doc_id", "reason").collect()}
    assert reason[100] == "word_length" and reason[101] == "upper_share" and reason[300] == "symbol_share"
    assert {reason[i] for i in range(60)} == {reason[200 + i] for i in range(60)} == {None}
    assert {reason[260 + i] for i in range(30)} == {"upper_share"}
    assert reason[400] == reason[401] == "base"
    assert {r["reason"] for r in quality_rules.judge_quality(frame(DOCS, none)).collect()} == {"base"}


def test_quality_fences_of_rare_measures_are_natural_breaks(frame):
    """Where quartiles are equal, the fence equals a plain search for the cut of greatest variance between the classes."""
    def text(i, symbols, lines):
        w = [f"v{i}x{k}" for k in range(40)]
        body = " ".join(x + "#" * (k < symbols) for k, x in enumerate(w))
        return "\n".join([body, *[f"same line {i}"] * lines])

    plans = [(i % 17 == 0, i % 9 == 0) for i in range(180)]
    rows = [(i, text(i, 20 + i % 5 if s else 0, (6 if i % 2 else 2) if d else 1), "en", "a", 0, "r", 1, True) for i, (s, d) in enumerate(plans)]
    fence = quality_rules.thresholds(frame(DOCS, rows).select("lang", "source", quality_rules.text_counts(F.col("text")).alias("counts"))).first()["fence"]
    counts = [quality_rules.counts_of(pa.array([r[1]])) for r in rows]
    for name, part, whole in (("symbol_share", "n_symbols", "n_words"), ("dup_line_share", "n_dup_lines", "n_lines")):
        values = sorted(min(1.0, c[part][0] / c[whole][0]) for c in counts)
        cuts = [(a + b) / 2 for a, b in zip(values, values[1:]) if a < b]

        def between(cut, values=values):
            low, high = [v for v in values if v < cut], [v for v in values if v > cut]
            return len(low) * len(high) * (np.mean(low) - np.mean(high)) ** 2

        assert abs(fence[name] - max(cuts, key=between)) < 1e-6
    kept = {r["doc_id"]: r["reason"] for r in quality_rules.judge_quality(frame(DOCS, rows)).select("row.doc_id", "reason").collect()}
    assert {i for i, r in kept.items() if r == "symbol_share"} == {i for i, (s, _) in enumerate(plans) if s and kept[i] != "base"}
    # without anything to part, nothing fails
    same = [(i, " ".join(f"w{(i * 40 + k):07}" for k in range(40)), "en", "a", 0, "r", 1, True) for i in range(40)]
    assert quality_rules.judge_quality(frame(DOCS, same)).where("kept").count() == 40


def test_exact_dedup(frame):
    rows = corpus() + [(500, "one"), (501, "one")]
    got = {r["doc_id"]: r for r in exact_dedup.mark_duplicates(docs(frame, rows), keep=("doc_id",)).collect()}
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[SPACES.sub(" ", t or "")].append(i)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(ids), len(ids), i == min(ids))
            assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    out = exact_dedup.drop_duplicates(docs(frame, rows))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(min(x) for x in groups.values())
    assert out.columns[-3:] == ["row", "counts", "kept"]
    assert exact_dedup.mark_duplicates(docs(frame, [])).count() == 0


def test_chunks_cover_the_text_and_clashes_change_the_seed(frame, monkeypatch):
    long = "a sentence, then more. " * 900 + "x" * 9000
    cut = docs(frame, [(1, long)]).select(exact_dedup.chunks(exact_dedup.normalised(F.col("text"))).alias("c")).first()["c"]
    assert "".join(cut) == SPACES.sub(" ", long) and all(len(c) <= exact_dedup.MAX_CHUNK + 1 for c in cut)
    plain = exact_dedup.identifiers
    monkeypatch.setattr(exact_dedup, "identifiers", lambda c, seed: (F.length(c).cast("long"), F.lit(0).cast("long")) if seed == 0 else plain(c, seed))
    rows = [(1, "ab"), (2, "cd"), (3, "ab")]
    assert exact_dedup.verified_seed(docs(frame, rows)) == 1
    assert [r["keep_id"] for r in exact_dedup.mark_duplicates(docs(frame, rows)).orderBy("doc_id").collect()] == [1, 2, 1]


def brute_components(rows, k, share):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= share * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k, texts", [(2, 2048), (5, 2048), (2, 6)])
def test_near_dedup(frame, monkeypatch, k, texts):
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", texts)  # small blocks take the way of large classes
    monkeypatch.setattr(near_dedup, "PIVOTS", 3)
    rows = corpus(60)
    rng = np.random.default_rng(5)
    base = ["b%d" % i for i in range(90)]
    for i in range(100):  # one large group of near copies, some beyond the threshold
        w = list(base)
        for p in rng.integers(0, 90, int(rng.integers(0, 9))):
            w[p] = f"m{i}x{p}"
        rows.append((1000 + i, " ".join(w)))
    got = near_dedup.near_components(docs(frame, rows), k=k)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows, k, 80)


def test_near_dedup_edges(frame):
    assert near_dedup.near_components(docs(frame, []), k=5).count() == 0
    rows = [(3, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (9, "A B C D E F G"), (4, None)]
    out = near_dedup.drop_near_duplicates(docs(frame, rows), k=5)
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [3, 3, 4, None]
    assert out.columns[-3:] == ["row", "counts", "kept"]


def test_components(frame):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["root"] for r in components(frame("a long, b long", edges)).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}


def test_mixing(frame):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else None, 0, "r", 1, True) for i in range(3000)]
    table = frame(DOCS, rows)
    weights = {"hot": 0.25, None: 0.75, "absent": 3.0}
    rates = {r["source"]: r for r in mixing.rates(table, weights=weights).collect()}
    assert abs(rates["hot"]["mean"] - 0.25 / (2 / 3)) < 1e-9 and abs(rates[None]["mean"] - 0.75 * 3) < 1e-9
    for r in rates.values():
        total, want = 0.0, []
        for k in range(len(r["steps"])):
            total += math.exp(k * math.log(r["mean"]) - r["mean"] - math.lgamma(k + 1))
            want.append(total)
        assert np.allclose(r["steps"], want) and 1 - want[-1] < 1e-12
    first = mixing.replicate(table, weights=weights)
    drawn = collections.Counter(r["doc_id"] for r in first.select("row.doc_id").collect())
    again = collections.Counter(r["doc_id"] for r in mixing.replicate(table.repartition(5), weights=weights).select("row.doc_id").collect())
    assert drawn == again
    of = {None: [drawn[i] for i in range(3000) if not i % 3], "hot": [drawn[i] for i in range(3000) if i % 3]}
    for source, counts in of.items():
        mean = rates[source]["mean"]
        assert abs(np.mean(counts) - mean) < 5 * math.sqrt(mean / len(counts))
        assert abs(np.var(counts) - mean) < 0.15 * mean + 0.05
    u = {r["doc_id"]: r["u"] for r in table.select("doc_id", mixing.uniform(17, F.col("doc_id")).alias("u")).collect()}
    for i, _, _, s, *_ in rows[:300]:
        assert drawn[i] == sum(p < u[i] for p in rates[s]["steps"])
    big = mixing.replicate(frame(DOCS, [(1, "t", "en", "s", 0, "r", 1, True)]), epochs=1000.0).count()
    assert 800 < big < 1200
    assert mixing.mix_sources(table, weights={"hot": 1.0}).where("source IS NULL").count() == 0
    assert mixing.mix_sources(table).columns == table.columns
    assert mixing.replicate(frame(DOCS, [])).count() == 0
    assert mixing.replicate(frame(DOCS, [(None, None, None, None, None, None, None, None)]), epochs=50.0).count() > 10


def test_lm_scores(frame, monkeypatch):
    monkeypatch.setattr(lm_score, "VOCABULARY", 150)
    monkeypatch.setattr(lm_score, "HEAD", 12)
    rows = corpus(80)
    lists = {i: (t or "").encode().split() for i, t in rows}
    single, pair = collections.Counter(), collections.Counter()
    for w in lists.values():
        single.update(w)
        pair.update(zip(w, w[1:]))
    total = sum(single.values())

    def name(word):
        data = np.frombuffer(word, np.uint8)
        return int(words(data, np.array([0, len(data)])).hashes().view(np.int64)[0])

    known = set(sorted(single, key=lambda w: (-single[w], name(w)))[:150])
    got = {r["doc_id"]: r for r in lm_score.score_documents(docs(frame, rows)).collect()}
    assert len(got) == len(rows)
    for i, w in lists.items():
        want = 0.0
        for k, x in enumerate(w):
            if k and x in known and w[k - 1] in known:
                want += math.log(pair[w[k - 1], x] / single[w[k - 1]])
            else:
                want += math.log(single[x] / total) + (math.log(lm_score.ALPHA) if k else 0)
        assert got[i]["n_words"] == len(w) and abs(got[i]["log_score"] - want) < 1e-6
        assert (got[i]["mean_log_score"] is None) == (not w)
    assert lm_score.score_documents(docs(frame, [])).count() == 0


def test_lm_scores_of_pairs_outside_the_frequent_words(frame, monkeypatch):
    monkeypatch.setattr(lm_score, "FREQUENT", 60, raising=False)
    monkeypatch.setattr(lm_score, "VOCABULARY", getattr(lm_score, "VOCABULARY") and 60)  # the cap there was, smaller
    monkeypatch.setattr(lm_score, "HEAD", 12)
    rows = corpus(80) + [(800, "once"), (801, "once twice"), (802, "twice once w1 once")]
    lists = {i: (t or "").split() for i, t in rows}
    single = collections.Counter(x for w in lists.values() for x in w)
    pair = collections.Counter(p for w in lists.values() for p in zip(w, w[1:]))
    for r in lm_score.score_documents(docs(frame, rows)).collect():
        w = lists[r["doc_id"]]
        want = sum(math.log(pair[u, v] / single[u]) for u, v in zip(w, w[1:])) + (math.log(single[w[0]] / sum(single.values())) if w else 0)
        assert r["n_words"] == len(w) and abs(r["log_score"] - want) < 1e-6


def brute_kneser_ney(texts):
    c = collections.Counter()
    for t in texts:
        w = ["<s>", *t, "</s>"]
        c.update(zip(w, w[1:]))

    def cuts(counts):
        n = [0, *[sum(v == k for v in counts) for k in (1, 2, 3, 4)]]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        return [min(k - 0.1, max(0.1, k - (k + 1) * y * n[k + 1] / max(n[k], 1))) for k in (1, 2, 3)]

    kinds = collections.Counter(v for _, v in c)
    d1, d2 = cuts(kinds.values()), cuts(c.values())
    cut = lambda d, n: d[min(n, 3) - 1]
    unknown = sum(cut(d1, n) for n in kinds.values()) / sum(kinds.values()) / (len(kinds) + 1)
    total, spared = collections.Counter(), collections.Counter()
    for (u, _), n in c.items():
        total[u] += n
        spared[u] += cut(d2, n)

    def p1(v):
        return (kinds[v] - cut(d1, kinds[v])) / sum(kinds.values()) + unknown if v in kinds else unknown

    def p(u, v):
        if u not in total:
            return p1(v)
        n = c[u, v]
        return ((n - cut(d2, n)) / total[u] if n else 0.0) + spared[u] / total[u] * p1(v)

    return lambda t: -sum(math.log(p(u, v)) for u, v in zip(["<s>", *t], [*t, "</s>"])) / (len(t) + 1)


def test_perplexity(frame, monkeypatch):
    monkeypatch.setattr(perplexity, "HEAD", 40)  # the rest goes through the shards
    rows = corpus(90)
    trusted = frame("doc_id long", [(i,) for i in range(0, 60)] + [(3,)])
    left_out = {r["doc_id"] for r in trusted.where(perplexity.kept_out(F.col("doc_id"))).collect()}
    texts = {i: (t or "").split() for i, t in rows}
    score = brute_kneser_ney([texts[i] for i in range(60) if i not in left_out])
    got = {r["doc_id"]: r for r in perplexity.judge_perplexity(docs(frame, rows), trusted).collect()}
    assert len(got) == len(rows)
    for i, w in texts.items():
        assert got[i]["n_words"] == len(w)
        if w:
            assert abs(got[i]["log_perplexity"] - score(w)) < 1e-6
            assert got[i]["kept"] == (got[i]["log_perplexity"] <= got[i]["fence"])
        else:
            assert got[i]["log_perplexity"] is None and not got[i]["kept"]
    q1, q3 = np.quantile([got[i]["log_perplexity"] for i in left_out], [0.25, 0.75])
    assert abs(got[0]["fence"] - (q3 + 3 * (q3 - q1))) < 1.0
    none = perplexity.judge_perplexity(docs(frame, rows[:5]), frame("doc_id long", []))
    assert [r["kept"] for r in none.collect()] == [True] * 5
    assert perplexity.judge_perplexity(docs(frame, []), trusted).count() == 0


def test_every_trusted_text_is_counted(frame):
    rows = [(i, f"a{i % 7} b{i % 11} c{i % 13}") for i in range(6000)]  # more than the 4,000 that were drawn
    trusted = frame("doc_id long", [(i,) for i, _ in rows])
    left_out = {r["doc_id"] for r in trusted.where(perplexity.kept_out(F.col("doc_id"))).collect()}
    score = brute_kneser_ney([t.split() for i, t in rows if i not in left_out])
    got = {r["doc_id"]: r["log_perplexity"] for r in perplexity.judge_perplexity(docs(frame, rows), trusted).collect()}
    assert all(abs(got[i] - score(rows[i][1].split())) < 1e-9 for i in range(200))
