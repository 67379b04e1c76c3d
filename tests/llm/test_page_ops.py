"""Pages, languages, tokens and the pipeline against plain versions."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from catalog_audit.llm import byte_bpe, html_text, language_id, near_dedup, quality_rules, url_filter
from catalog_audit.llm.sampling import per_class
from catalog_audit.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, row string, host string"


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as f:
        content = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return byte_bpe.Codec(content, public_tokenizers.PATTERN), tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text(alphabet="abcdeinorst' éß日\n\t", max_size=80)))
def test_encoding_is_the_reference_encoding(codec, text):
    own, other = codec
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
    assert own.decode(ids) == text.encode()
    assert "".join(own.decode_stream(np.frombuffer(ids, "<u4").tolist())) == text


def test_encoding_of_odd_texts_and_after_a_restart(codec, monkeypatch):
    own, other = codec
    monkeypatch.setattr(byte_bpe, "MAX_TRANSITIONS", 50)
    monkeypatch.setattr(byte_bpe, "MAX_PIECES", 5)
    rng = random.Random(4)
    texts = ["", "a" * 4000, "<|endoftext|>", " " * 700, "  two\n \n x", "日本語" * 300, "ab" * 900] + [
        "".join(rng.choice("abcdefghijklmno") for _ in range(40)) for _ in range(60)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == other.encode_ordinary(t)


def test_words_pass_by_the_pattern(codec, monkeypatch):
    own, other = codec
    seen, pieces = [], own.pieces
    monkeypatch.setattr(own, "pieces", lambda t: seen.append(t) or pieces(t))
    text = "Thst thonerex, thonerex éêèlleux. ab'c x1 ª ǅ ʰ ⁿ Ⅷ ա, 日本! ,, a.. 'll end?"
    for _ in range(2):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == other.encode_ordinary(text)
    assert " ab'c" in seen and not any("thonerex" in t or "lleux" in t or "end" in t for t in seen)


def test_a_run_in_use_outlives_the_others(codec, monkeypatch):
    own, other = codec
    monkeypatch.setattr(byte_bpe, "MAX_PIECES", 8)
    for i in range(40):
        text = f"a hotxrun{' b' * i} q{chr(97 + i % 26)}{'z' * i}"
        assert np.frombuffer(own.encode(text), "<u4").tolist() == other.encode_ordinary(text)
        assert "hotxrun" in own.known_runs or "hotxrun" in own.older_runs
    assert len(own.known_runs) + len(own.older_runs) < 20


def test_a_share_of_the_memory_gives_the_same_ids(codec, monkeypatch):
    own, other = codec
    monkeypatch.setattr(byte_bpe, "MAX_TRANSITIONS", 800)
    monkeypatch.setattr(byte_bpe, "MAX_PIECES", 80)
    small = byte_bpe.Codec(b"\n".join(base64.b64encode(t) + b" %d" % r for r, t in own.entries.items()), public_tokenizers.PATTERN, share=8)
    rng, most = random.Random(5), 0
    for _ in range(60):
        text = " ".join("".join(rng.choice("abcdefghijkl") for _ in range(9)) for _ in range(4))
        assert np.frombuffer(small.encode(text), "<u4").tolist() == other.encode_ordinary(text)
        most = max(most, len(small.transducer.moves) + len(small.transducer.starts))
    assert most < 150 and len(small.known_runs) + len(small.older_runs) < 20


def test_utf8_machine():
    text = "aé日😀z"
    machine = byte_bpe.Utf8Machine()
    data = text.encode()
    assert "".join(machine.feed(data[i:i + 1]) for i in range(len(data))) + machine.close() == text
    machine = byte_bpe.Utf8Machine()
    assert machine.feed(b"\xff\xe6\x97") + machine.feed(b"x") + machine.close() == "\ufffd\ufffdx"


def test_round_trip_decodes_by_the_stream(codec, monkeypatch):
    own, _ = codec
    text = "aé日😀 " * 50
    ids = own.encode(text)
    for block in (1, 3, 4096):
        monkeypatch.setattr(byte_bpe, "BLOCK", block, raising=False)
        assert own.decoded(ids) == text.encode()
    half = np.array([own.transducer.ranks[b"\xe6"]], "<u4").tobytes()  # a character that never ends
    assert own.decoded(ids + half) == text.encode() + "\ufffd".encode() and own.decode(half) == b"\xe6"


def test_round_trip(spark, frame):
    rows = [(1, "Hello, world's end"), (2, None), (3, ""), (4, "x" * 3000), (4, "x" * 3000)]
    bpe = byte_bpe.ByteBpe(spark)
    made = frame("doc_id long, text string", rows).select("doc_id", "text", bpe.round_trip(F.col("text")).alias("t"), bpe.encode(F.col("text")).alias("e"))
    for r in made.select("*", bpe.decode(F.col("e")).alias("d")).collect():
        assert bytes(r["t"]["decoded"]).decode() == r["d"] == (r["text"] or "") and r["e"] == r["t"]["ids"]
    assert made.where("doc_id = 0").count() == 0


def plain_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for v, r in url_filter.RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_rules_and_models(frame):
    urls = ["http://A.Example.COM/en/1", "https://www.example.com/en/2?x=/y", "http://example.com", "x://y.net/es/", "x://net/fr/q#z", "nothing", None, "",
            "a://b://c.com/d", "http://xcom/", "http://é.com/É?q", "http://www.example.com/EN/"]
    urls += [f"http://good{i}.com/de/{i}" for i in range(60)] + [f"http://bad{i}.net/es/{i}" for i in range(60)] + ["http://new.org/de/5", "http://bad999.org/es/7"] * 2
    got = url_filter.judge_urls(frame(PAGES, [(i, u, "", "r", "h") for i, u in enumerate(urls)])).collect()
    assert len(got) == len(urls)
    by = {}
    for r in got:
        host, path, rule, verdict = plain_rule(r["row"]["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert verdict in (None, r["verdict"])
        by[r["row"]["url"]] = r["verdict"]
    assert by["http://new.org/de/5"] == "allow" and by["http://bad999.org/es/7"] == "block" and by[None] == by["nothing"] == "allow"
    assert {r["verdict"] for r in url_filter.judge_urls(frame(PAGES, [(1, "http://z.org/", None, None, None)])).collect()} == {"allow"}
    assert url_filter.judge_urls(frame(PAGES, [])).count() == 0


def test_url_models_read_the_query(frame):
    urls = [f"http://h{i}.com/p?view=article{i}" for i in range(60)] + [f"http://h{i}.net/es/p?click=banner{i}#pop" for i in range(60)]
    urls += ["http://NEW.org/p?view=article7", "http://new.org/p?click=banner7#pop"]
    got = {r["row"]["url"]: r for r in url_filter.judge_urls(frame(PAGES, [(i, u, "", "r", "h") for i, u in enumerate(urls)])).collect()}
    good, bad = got[urls[-2]], got[urls[-1]]
    assert (good["host"], good["path"]) == (bad["host"], bad["path"]) == ("new.org", "/p") and good["rule"] is None
    assert (good["verdict"], bad["verdict"]) == ("allow", "block") and good["score"] > bad["score"]


def test_markov_model_and_cut():
    m = url_filter.Markov({"": {"a": 3, "b": 1}, "a": {"b": 2}})
    base = lambda n: (n + 2 / url_filter.ALPHABET) / 6
    assert abs(m.log_likelihood("ab") - np.log(base(3)) - np.log((2 + base(1)) / 3)) < 1e-12
    assert url_filter.calibrated([(-2.0, False), (-1.0, False), (1.0, True), (3.0, True)]) == 0.0
    assert url_filter.calibrated([(1.0, True)]) == 0.0


def test_url_models_count_every_labelled_address(frame):
    # more addresses than the 20,000 that were drawn; each has its own number
    urls = [f"http://a.com/x{i}" for i in range(14_000)] + [f"http://a.net/es/y{i}" for i in range(14_000)] + ["http://new.org/x77", "http://new.org/y5?é"]
    got = {r["row"]["url"]: r for r in url_filter.judge_urls(frame(PAGES, [(i, u, "", "r", "h") for i, u in enumerate(urls)])).collect()}
    address = lambda u: u.partition("://")[2]
    spark = frame("i int", []).sparkSession
    held = {r["a"] for r in spark.createDataFrame([(address(u),) for u in urls], "a string").where(F.pmod(F.xxhash64(F.lit(3), "a"), F.lit(4)) == 0).collect()}
    models = []
    for part in (urls[:14_000], urls[14_000:28_000]):
        counts = {}
        for a in (address(u) for u in part if address(u) not in held):
            for i, ch in enumerate(a):
                for k in range(min(i, url_filter.ORDER) + 1):
                    n = counts.setdefault(a[i - k:i], {})
                    n[ch] = n.get(ch, 0) + 1
        models.append(url_filter.Markov(counts))
    for u in [*urls[:300], *urls[-2:]]:
        a = address(u)
        assert abs(got[u]["score"] - (models[0].log_likelihood(a) - models[1].log_likelihood(a)) / len(a)) < 1e-9
    assert (got[urls[-2]]["verdict"], got[urls[-1]]["verdict"]) == ("allow", "block")


def test_url_tables_do_not_pass_the_driver(frame, monkeypatch):
    # small files, many characters: by its file's size a table of spelled out addresses would be broadcast
    urls = [f"http://a.com/x{i}" for i in range(60)] + [f"http://a.net/es/y{i}" for i in range(60)] + ["http://new.org/x7", None]
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    store = url_filter.materialize
    monkeypatch.setattr(url_filter, "materialize", lambda df, name: store(seen(df), name))
    judged = seen(url_filter.judge_urls(frame(PAGES, [(i, u, "", "r", "h") for i, u in enumerate(urls)])))
    assert judged.count() == len(urls)
    assert sum(p.count("SortMergeJoin") for p in plans) > 10 and not any("Broadcast" in p for p in plans)


def test_the_cut_of_cells_is_the_cut_of_scores(frame):
    rnd = random.Random(4)
    scored = [(rnd.gauss(1.0 if ok else -1.0, 0.8), ok) for ok in [True, False, False] * 60]
    assert abs(url_filter.cut_of(frame("score double, good boolean", scored)) - url_filter.calibrated(scored)) < 1e-12
    assert url_filter.cut_of(frame("score double, good boolean", scored[:1])) == 0.0


def test_languages(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    apart = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(table.where(~apart))
    told = language_id.identify(table.where(apart), model).select("row.lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in told) > 0.97 * len(told)
    assert all(0 <= r["score"] <= 1 for r in told)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 $$"), (4, "the of and that with"), (5, "日本")], "doc_id long, text string")
    got = [(r["lang_pred"], r["score"]) for r in language_id.identify(odd, model).orderBy("row.doc_id").collect()]
    assert [g[0] for g in got[:3]] == ["und"] * 3 and got[3][0] == "en" and got[4][0] != "und"
    assert language_id.fit(table.where("false")) is None
    assert {r["lang_pred"] for r in language_id.identify(odd, None).collect()} == {"und"}


def test_machines_of_pairs_vote():
    rng = np.random.default_rng(4)
    langs = ["a", "b", "c", "d"]
    centre = rng.normal(size=(4, language_id.DIMENSIONS)).astype(np.float32)
    y = np.array([langs[i % 4] for i in range(80)], object)
    x = np.array([centre[langs.index(v)] for v in y]) * 0.05 + rng.normal(size=(80, language_id.DIMENSIONS)).astype(np.float32) * 0.03
    machines = language_id.fit_pairs(x, y, langs)
    assert sorted(machines) == [(i, j) for i in range(4) for j in range(i + 1, 4)]
    other = x.copy()
    other[y == "c"] += 7  # rows of a third language
    assert (language_id.fit_pairs(other, y, langs)[0, 1] == machines[0, 1]).all()
    assert not (language_id.fit_pairs(other, y, langs)[0, 2] == machines[0, 2]).all()
    probe = rng.normal(size=(200, language_id.DIMENSIONS)).astype(np.float32) * 0.05
    pick, chance = language_id.voted(probe, 4, machines)
    for row, got in zip(probe, pick):
        votes, sums = [0] * 4, [0.0] * 4
        for (i, j), w in machines.items():
            m = float((row[None, :] @ w[:-1] + w[-1])[0, 0])
            votes[i if m > 0 else j] += 1
            sums[i] += m
            sums[j] -= m
        tied = [k for k in range(4) if votes[k] == max(votes)]
        assert sums[got] >= max(sums[k] for k in tied) - 1e-4 and got in tied
    assert ((0 <= chance) & (chance <= 1)).all()
    assert language_id.voted(probe, 1, {})[1].tolist() == [1.0] * 200


def test_language_rows_that_repeat_clash_or_run_long(frame):
    word = {"en": "the and of with that ", "de": "und der nicht mit dem ", "nl": "het van een niet dat "}
    known = [(i, word[v] * (3 + i % 5) + f"x{i}", v) for i, v in enumerate(list(word) * 12)] + [(7, word["en"] * 9, "en")] * 40
    model = language_id.fit(frame("doc_id long, text string, lang string", known))
    assert model.families == ["germanic"] and sorted(model.within["germanic"][1]) == [(0, 1), (0, 2), (1, 2)]
    rows = [(1, word["de"] * 40000, "r", "x", "y", 0.5)] + [(2, word["nl"] * 4, "r", "x", "y", 0.5)] * 3
    got = language_id.identify(frame("doc_id long, text string, row string, lang_pred string, written string, score double", rows), model, keep=("doc_id", "row"))
    assert sorted((r["row"]["doc_id"], r["lang_pred"]) for r in got.collect()) == [(1, "de"), (2, "nl"), (2, "nl"), (2, "nl")]


def test_samples_are_even_and_need_no_exchange_of_texts(frame):
    rows = frame("lang string, text string", [("en", f"t{i}") for i in range(3000)] + [("de", f"u{i}") for i in range(300)] + [("fr", f"v{i}") for i in range(20)] + [(None, "n")])
    drawn = per_class(rows, "lang", 600, "text")
    sizes = {r["lang"]: r["n"] for r in drawn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert 140 < sizes["en"] < 260 and 140 < sizes["de"] < 260 and sizes["fr"] == 20 and None not in sizes
    assert drawn.columns == ["lang", "text"] and per_class(rows.limit(0), "lang", 5, "text").count() == 0
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def page(i, body, extra=""):
    return (f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style></head><body><header><a href='/'>Site</a></header><nav><ul><li>m{i}</li></ul></nav>"
            f"<div class=cookie-notice>We use cookies</div><div class='ad'>buy {i}</div>{body}<aside>side {i}</aside>{extra}<form>f<input></form><footer>&copy; f{i}")


def test_main_text(frame):
    rows = [(i, f"http://a.org/{i}", page(i, f"<article><h1>Title {i}</h1><p><b>one &amp; two<br>\n three</p><p>same words<p>last {i}</article>",
                                          "<section id='comments'><p>reader says</p></section>"), "r", "h") for i in range(8)]
    rows += [(20 + i, f"http://b.org/{i}", page(i, f"<div><p>Plain text {i}</p><p>Share this page</p></div>"), "r", "h") for i in range(8)]
    rows += [(40, None, None, "r", "h"), (41, "u", "", "r", "h"), (42, "http://c.org/", "a < b <p>x<script>var t='</p>'</script>y <", "r", "h"),
             (43, "http://c.org/", "<div>" * 3000 + "deep" + "x" * 90000, "r", "h")]
    table = frame(PAGES, rows)
    got = {r["page_id"]: r["text"] for r in html_text.extract(table).select("row.page_id", "text").collect()}
    for i in range(8):
        assert got[i] == f"Title {i}\none & two three\nsame words\nlast {i}"
        assert got[20 + i] == f"Plain text {i}"  # what every page of the host repeats is its template
    assert got[40] == got[41] == "" and got[42] == "a < b\nxy <" and got[43] == "deep" + "x" * 90000
    made = {r["host"]: r for r in html_text.templates(table).collect()}
    assert set(made) == {"a.org", "b.org"} and made["a.org"]["has_main"] and not made["b.org"]["has_main"]
    assert html_text.extract(table.where("false")).count() == 0


def test_equal_vectors_make_one_class(frame):
    rows = [(i, f"http://a.org/{i}", "<main>" + "<ul><li><a>x</a></li><li><a>y</a></li></ul>" * (i % 3 + 1) + "</main>", "r", "h") for i in range(9)]
    got = html_text.templates(frame(PAGES, rows)).first()
    main, ul, li = sorted(got["classes"], key=lambda c: c["per_page"])
    assert [(c["size"], c["per_page"]) for c in (main, ul, li)] == [(1, 1.0), (1, 2.0), (2, 4.0)]  # li and a: one class
    assert (main["inside"], ul["inside"], li["inside"]) == (None, main["class"], ul["class"])
    assert len(got["tags"]) == 4


@pytest.mark.parametrize("cut", ["<svg viewBox='0'/>", "<canvas/>", "<object data='x'/>", "<math/>", "<svg><path d='1'/>", "<svg/><svg><text>no</text></svg>",
                                 "<svg><svg><text>no</text></svg></svg>", "<select><option>no", "<object data='x'>", "<canvas>", "<iframe src='x'>", "<textarea>no",
                                 "<div><noscript>no</div>", "<svg><foreignObject><p>no</p></foreignObject></svg>", "<script>no</p></script>"])
def test_a_cut_element_does_not_cut_the_page(cut):
    page = f"<article><p>one</p>{cut}<p>two</p><p>x<svg>no</svg>y</p></article><footer>no</footer>"
    assert html_text.main_text(page, set(), set(), False) == "one\ntwo\nxy"
    assert html_text.main_text(cut + "<p>two</p>", set(), set(), False) == "two"


def test_math_and_fallback_texts_are_kept():
    page = "<article><p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><object data=a><p>shown instead</p></object><canvas>a chart</canvas></article>"
    assert html_text.main_text(page, set(), set(), False) == "let x=2\nshown instead\na chart"
    assert html_text.main_text("<p>a</p><script>never closed<p>b", set(), set(), False) == "a"


def test_copies_of_a_page_do_not_make_it_a_template(frame):
    body = "<div><p>The whole text.</p><p>Second part.</p></div>"
    rows = [(i, f"http://a.org/{i}", body, "r", "h") for i in range(36)]
    rows += [(40 + i, f"http://a.org/n{i}", f"<div><p>Other text {i}</p></div>", "r", "h") for i in range(4)]
    rows += [(50 + i, None, body, "r", "h") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(frame(PAGES, rows)).select("row.page_id", "text").collect()}
    assert {got[i] for i in (*range(36), *range(50, 59))} == {"The whole text.\nSecond part."}
    assert [got[40 + i] for i in range(4)] == [f"Other text {i}" for i in range(4)]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_runs_over_all_rows(spark, name):
    made = QUERIES[name](spark, SF)
    name_of = {"page_id": "pages", "conv_id": "conversations"}
    key = next((c for c in name_of if c in made.columns), "doc_id")
    n = spark.read.parquet(f"{SF}/{name_of.get(key, 'documents')}.parquet").select(key).distinct().count()  # documents and pages have an id of their own each
    assert made.count() == n or name == "op5_source_mixing"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_statement(spark, name):
    import duckdb

    import check
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    made, cur = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    assert check.rows_of(made.columns, made.collect()) == check.rows_of([d[0] for d in cur.description], cur.fetchall())


def test_pipeline(spark, frame, codec):
    rng = np.random.default_rng(2)
    clean = [" ".join(f"word{a}" for a in rng.integers(0, 5000, 60)) for _ in range(40)]
    near = [t.replace(t.split()[30], "other", 1) for t in clean[:5]]
    rows = list(enumerate(clean + clean[:10] + near + [None, "", "too short", "spam " * 60]))
    docs = frame("doc_id long, text string, lang string, source string, n_chars long", [(i, t, "en", "s", len(t or "")) for i, t in rows])
    kept = docs
    for (_, stage), want in zip(corpus_pipeline.STAGES[:3], (set(range(55)), set(range(40)) | set(range(50, 55)), set(range(40)))):
        kept = stage(spark, kept, SF)
        assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns
    mixed = corpus_pipeline.mix(spark, kept, SF)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= set(range(40))
    for r in corpus_pipeline.tokenize(spark, mixed, SF).collect():
        text = dict(rows)[r["doc_id"]]
        ids = codec[1].encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert near_dedup.drop_near_duplicates(quality_rules.filter_quality(docs.where("false"))).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "source mixing", "byte bpe"]
