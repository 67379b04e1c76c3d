"""Conversation repair, tokenizer alignment and the Jaccard join against brute force."""

import functools
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from catalog_audit.llm import align, ngram_join, repair

WHITE = "\x20\t\n\x0b\x0c\r"


def cheapest(rows, costs):
    """(cost, edits) by trying everything; rows are (initial, must delete, truncated)."""
    n = len(rows)

    @functools.cache
    def rest(i, state, inserted):
        found = []
        if inserted < 3:
            c, e = rest(i, "a" if state == "u" else "u", inserted + 1)
            found.append((c + costs.insert, "I" + e))
        if i == n:
            return min([*found, (0, "")]) if state in ("", "a") else min(found, default=(10**9, ""))
        initial, gone, short = rows[i]
        c, e = rest(i + 1, state, 0)
        found.append((c + costs.delete, "D" + e))
        if not gone:
            more = costs.truncated * short
            to = "a" if state == "u" else "u"
            c, e = rest(i + 1, to, 0)
            found.append((c + costs.rerole + more, "R" + e))
            if initial == to or initial == "s" and state == "":
                c, e = rest(i + 1, initial, 0)
                found.append((c + costs.keep + more, "K" + e))
        return min(found)

    return rest(0, "", 0)


def searched(rows, costs):
    v, out, held = repair.Viterbi(costs), "", 0
    for i, r in enumerate(rows):
        out += v.step(*r).decode()
        held = max(held, i + 1 - len(out.replace("I", "")))
    cost, edits = v.finish()
    return (cost, out + edits.decode()), held


ROW = st.tuples(st.sampled_from("suaax "), st.booleans(), st.booleans())


@settings(max_examples=300, deadline=None)
@given(st.lists(ROW, max_size=14), st.sampled_from([repair.Costs(), repair.Costs(0, 1, 1, 1, 1), repair.Costs(1, 1, 3, 1, 0), repair.Costs(0, 3, 4, 1, 2)]))
def test_viterbi_is_cheapest_and_least(rows, costs):
    assert searched(rows, costs)[0] == cheapest(tuple(rows), costs)


def test_viterbi_holds_little():
    turns = [("s", False, False)] + [("ua"[i % 2], False, i % 7 == 0) for i in range(20000)]
    (cost, edits), held = searched(turns, repair.Costs())
    assert held < 20 and len(edits.replace("I", "")) == len(turns)
    assert searched([("u", True, False)] * 5000, repair.Costs())[0] == (10000, "D" * 5000)


def brute_repair(table):
    rows = {}
    for conv, turn, role, text in table:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(name.encode()) % 20
        mine = rows.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, mine in rows.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, faults = set(), []
        for _, role, text in mine:
            last = text.strip(WHITE)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit = cheapest(tuple((r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(mine, faults)), repair.Costs())
        lines, at, state = [], iter(mine), ""
        for e in audit:
            _, role, text = (None, "", "") if e == "I" else next(at)
            if e == "D":
                continue
            role = role if e == "K" else "assistant" if state == "u" else "user"
            state = role[:1]
            lines.append(f"{role}:{text}")
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_repair_equals_brute_force(spark, frame):
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = [(None, None, None, None), (None, 1, "user", "Hi."), (900, None, "assistant", "A."), (900, None, "assistant", "A."), (900, 3, "", "x"), (900, 3, "tool", "Ok!"),
           (900, 9, "user", "y " * 200000 + "."), (901, 0, "system", "\n \t"), *[(902, i, "user", "same.") for i in range(70)], *[(1000 + i, 0, "user", "Yes?") for i in range(60)]]
    table = given + odd + given[:9]
    df = frame("conv_id long, turn long, role string, text string, kind string, repeated int, end string, times int", [(*r, "k", 1, "e", 9) for r in table])
    got = {r[0]: tuple(r)[1:] for r in repair.repair_digests(repair.damage(df)).collect()}
    assert got == brute_repair(table)
    assert repair.repair_digests(repair.damage(df.limit(0))).count() == 0


def test_repaired_turns_are_legal_and_match_the_digest(frame):
    rows = repair.as_rows(frame("conv_id long, turn long, role string, text string", [(1, i, r, t) for i, (r, t) in enumerate(
        [("assistant", "Hello."), ("user", "A?"), ("user", "B?"), ("assistant", "cut"), ("assistant", " "), ("assistant", "C.")])]))
    turns = repair.repair_turns(rows).orderBy("place").collect()
    digest = repair.repair_digests(rows).first()
    assert "".join(t["edit"] for t in turns) == digest["audit"]
    kept = [t for t in turns if t["role"] is not None]
    assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in kept))
    assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in kept).encode()).hexdigest() == digest["repaired_sha256"]


@functools.cache
def vocabularies():
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def spelled(text):
    """Whole-text tokens of both vocabularies as (id, bytes)."""
    a, b = vocabularies()
    stand = align._byte_alphabet()
    left = [(i, bytes(stand[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes.fromhex(p[3:5]) if re.fullmatch("<0x..>", p) else p.replace("\u2581", " ").encode()))
    whole = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else ([], [])


def ends(tokens):
    at, out = 0, {}
    for k, (_, x) in enumerate(tokens):
        at += len(x)
        out[at] = k
    return out


def brute_alignment(texts):
    found, totals = [], Counter()
    for t in texts:
        left, right = spelled(t) if t else ([], [])
        ea, eb = ends(left), ends(right)
        cuts = sorted(ea.keys() & eb.keys())
        links = [(left[ea[c]][0], right[eb[c]][0]) for c in cuts]
        groups, i, j = [], 0, 0
        for c in cuts:
            groups.append(",".join(str(x) for x, _ in left[i:ea[c] + 1]) + "|" + ",".join(str(x) for x, _ in right[j:eb[c] + 1]))
            i, j = ea[c] + 1, eb[c] + 1
        totals.update(links)
        found.append((len(left), len(right), links, ";".join(groups)))
    best = {}
    for (_, b), n in totals.items():
        best[b] = max(best.get(b, 0), n)
    return [(a, b, len(links), len(links), sum(totals[x] == best[x[1]] for x in links), sum(totals[x] for x in links),
             hashlib.sha256(g.encode()).hexdigest() if a else "") for a, b, links, g in found]


TEXTS = [None, "", " ", "one two  three\n four", "<|endoftext|> <s> </s><unk> x", "it's 1234 \u00e9\u0301 \ufb01 \U0001f600!\r\n\tend ", "x\u2581 y", "a\x1c b\x85 c\u00a0 d \u3000 e",
         "  lead", "\x00nul <0x41>", "word " * 3000, "y" * 20000, "\u4e2d\u6587 \u0e44\u0e17\u0e22"]


@pytest.mark.parametrize("head", [align.HEAD, 3])
def test_alignment_equals_brute_force(spark, frame, monkeypatch, head):
    monkeypatch.setattr(align, "HEAD", head)
    monkeypatch.setattr(align, "UNITS", 500)
    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40).collect()]
    texts = TEXTS + real + TEXTS[3:6] * 2
    df = frame("doc_id long, text string, row string, uid int, odd string, same int, pair long", [(i % 50, t, "r", 1, "o", 2, 3) for i, t in enumerate(texts)])
    got = align.align(df.repartition(3)).select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(tuple(r) for r in got) == sorted((i % 50, *x) for i, x in enumerate(brute_alignment(texts)))
    assert align.align(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'1.\u00e9\u2581\x1c\u00a0"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_units_give_the_tokens_of_the_whole_text(text):
    both = align.aligner(align.VOCABULARY_A, align.VOCABULARY_B)
    units = both.units([align._BETWEEN.split(text) if text else []])[0]
    want = brute_alignment([text])[0]
    if () in units or not text:
        assert want[0] == 0
    else:
        assert hashlib.sha256(";".join(u[2] for u in units).encode()).hexdigest() == want[-1]


def shingle_set(text, k=3):
    w = [x for x in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute_components(rows, share=90):
    """(id, size, smallest id reachable) by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, (i, x) in enumerate(sets):
        for j, y in sets[:p]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= share * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(x), find(i)) for i, x in sets)


def look_alikes(seed=5):
    """Texts at every similarity about the threshold, chains of them, copies, shared passages, short and odd ones."""
    rng = np.random.default_rng(seed)
    words = ["w%d" % i for i in range(3000)]
    draw = lambda n: rng.choice(words, n).tolist()
    passage, texts = draw(60), []
    for _ in range(14):
        base = draw(int(rng.integers(4, 160)))
        for _ in range(8):
            own = list(base)
            for _ in range(int(rng.integers(0, max(2, len(own) // 45)))):
                own[int(rng.integers(len(own)))] = "new%d" % rng.integers(10**6)
            texts.append(" ".join(own[:len(own) - int(rng.integers(0, max(1, len(own) // 12)))]))
    texts += [" ".join(draw(8) + passage + draw(8)) for _ in range(12)]
    chain = draw(120)
    for i in range(24):  # each is near the next, the ends are far apart
        texts.append(" ".join(chain))
        chain = chain[2:] + draw(2)
    texts += [texts[0].upper().replace(" ", "\t\n"), texts[20], None, "", " \n", "one", "ONE ", "one two", "one two three", "x" * 9000, " ".join(draw(7000))]
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("block", [ngram_join.BLOCK_SETS, 5])
def test_ngram_join_equals_brute_force(frame, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rows = look_alikes()
    df = frame("doc_id long, text string, id int, root int, mark int, keys int, row string", [(i, t, 1, 2, 3, 4, "r") for i, t in rows])
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(df.repartition(3)).collect())
    assert got == brute_components(rows)


def test_ngram_join_edge_rows(frame, monkeypatch):
    text = " ".join("w%d" % i for i in range(50))
    rows = [(None, text), (7, text), (7, "another text of four"), (9, "another text of four"), (5, text), (5, text), (None, text)]
    df = frame("doc_id long, text string", rows)
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(df).collect()), key=repr)
    assert got == sorted([(None, 48, None)] * 2 + [(7, 48, 5), (7, 2, 5), (9, 2, 5)] + [(5, 48, 5)] * 2, key=repr)
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0


def test_one_dense_class_in_many_blocks(frame, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    rng = np.random.default_rng(1)
    base = rng.choice(["w%d" % i for i in range(500)], 100).tolist()
    rows = []
    for i in range(150):
        own = list(base[:90 + i % 11])
        own[int(rng.integers(len(own)))] = "n%d" % i
        rows.append((i, " ".join(own)))
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(frame("doc_id long, text string", rows)).collect())
    assert got == brute_components(rows)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 2**32))
def test_linked_sets_share_a_part(n, lost, added, seed):
    rng = np.random.default_rng(seed)
    members = np.unique(rng.integers(0, 2**63, n + added).astype(np.uint64))
    x, y = np.sort(rng.permutation(members)[:n]), np.sort(rng.permutation(members)[lost:])
    if not len(y):
        return
    common = len(np.intersect1d(x, y))
    keys, of = ngram_join.part_keys(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), np.array([len(x), len(y)]), 90)
    if 100 * common >= 90 * (len(x) + len(y) - common):
        assert np.intersect1d(keys[of == 0], keys[of == 1]).size


def test_tree_bounds_lose_no_link_and_spare_work():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, int(rng.integers(5, 300))).astype(np.uint64)
        sets += [np.unique(np.append(base[int(rng.integers(0, 1 + len(base) // 15)):], rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64))) for _ in range(5)]
    h, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tree = ngram_join.Tree(h, of, len(sets), ngram_join.width_of(300))
    met = set()
    ngram_join.traverse(tree, tree, 90, np.arange(len(sets)), np.arange(len(sets)), lambda i, j: met.add(frozenset((tree.order[i], tree.order[j]))))
    linked = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if ngram_join.joined(sets[i], sets[j], 90)}
    assert linked and linked <= met and len(met) < 3 * len(linked)
