import random

import pytest
from conftest import rows

from catalog_audit.operators import graph

FIELDS = "id string, name string, datasource_id string, formula string, is_calculated boolean"


def resolve(frame, fields, **kw):
    t = {"fields": frame(FIELDS, fields)}
    t["bindings"] = graph.token_bind(t)
    out = {r.field_id: r for r in graph.resolve_formulas(t, **kw).collect()}
    return out, t


def calc(i, name, formula, ds="d"):
    return (i, name, ds, formula, True)


def col(i, name, ds="d"):
    return (i, name, ds, None, False)


def test_cycle_pair(frame):
    out, _ = resolve(frame, [calc("a", "Cycle A", "[Cycle B] + 1"), calc("b", "Cycle B", "[Cycle A] + 2")])
    assert (out["a"].resolution_status, out["a"].resolution_depth) == ("cycle", 3)
    assert (out["b"].resolution_status, out["b"].resolution_depth) == ("cycle", 3)
    assert out["a"].resolved_formula == "(([Cycle B] + 1) + 2) + 1"


def test_depth_cap(frame):
    chain = [col("s", "Sales"), calc("c00", "Deep 00", "SUM([Sales])")]
    chain += [calc(f"c{n:02d}", f"Deep {n:02d}", f"[Deep {n - 1:02d}] + 1") for n in range(1, 16)]
    out, _ = resolve(frame, chain)
    assert (out["c12"].resolution_status, out["c12"].resolution_depth) == ("resolved", 13)
    assert (out["c13"].resolution_status, out["c13"].resolution_depth) == ("too_deep", 14)
    assert (out["c15"].resolution_status, out["c15"].resolution_depth) == ("too_deep", 14)
    assert out["c13"].resolved_formula.count("(") == 13 + 1  # the raw text of the last frame keeps SUM(


def test_dangling_unicode_collision_ambiguous(frame):
    out, t = resolve(frame, [
        calc("x", "X", "[No Such Field] + 1"), col("s", "Sales"), calc("n", "Ingresos ñ", "[Sales]"), calc("m", "M", "[ ingresos Ñ ] * 1.1"),
        calc("p", "P", "[Twin] + [Twin]"), col("t1", "Twin"), col("t2", "twin "),
        col("s2", "Sales", "e"), calc("q", "Q", "[Sales]", "e"), calc("z", "Z", "[X] + [Sales] + [X]")])
    assert out["x"].resolution_status == "unresolved_reference" and out["x"].resolved_formula == "[No Such Field] + 1"
    assert out["m"].resolved_formula == "([Sales]) * 1.1" and out["m"].resolution_status == "resolved"
    assert out["p"].resolution_status == "unresolved_reference" and out["p"].resolved_formula == "[Twin] + [Twin]"
    assert graph.ambiguous_refs(t).first().ambiguous_refs == 2
    assert out["q"].resolution_depth == 1
    assert ("q", "s2") in rows(graph.reference_edges(t))
    # an unresolved child makes its parent unresolved; the same child may stand twice
    assert out["z"].resolution_status == "unresolved_reference"
    assert out["z"].resolved_formula == "([No Such Field] + 1) + [Sales] + ([No Such Field] + 1)"


def test_empty_and_null_formulas(frame):
    out, _ = resolve(frame, [calc("a", "A", None), calc("b", "B", ""), calc("c", "C", "[A][B]")])
    assert out["a"].resolved_formula == "" and out["a"].normalized_hash == ""
    assert out["c"].resolved_formula == "()()" and out["c"].resolution_depth == 2


def brute(fields, cap=12):
    """Independent check: expand by explicit search over one small estate."""
    by_name = {f[1].lower(): f for f in fields}

    def visit(f, trail):
        text, depth = f[3], len(trail)
        if f[0] in trail:
            return text, 3, depth
        if depth > cap:
            return text, 2, depth
        worst, deep, out = 0, depth, ""
        for piece in text.replace("[", "\0[").replace("]", "]\0").split("\0"):
            if piece.startswith("["):
                g = by_name.get(piece[1:-1].lower())
                if g is None:
                    worst = max(worst, 1)
                elif g[4]:
                    sub, w, d = visit(g, trail + (f[0],))
                    worst, deep, piece = max(worst, w), max(deep, d), f"({sub})"
            out += piece
        return out, worst, deep

    return {f[0]: visit(f, ()) for f in fields if f[4]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs_match_brute_force(frame, seed):
    rnd = random.Random(seed)
    n = 22
    fields = [col("s", "Sales")]
    for i in range(n):
        refs = []
        for _ in range(rnd.choice([0, 1, 1, 2])):
            kind = rnd.random()
            if kind < 0.15:
                refs.append("[Sales]")
            elif kind < 0.2:
                refs.append("[Missing]")
            elif kind < 0.93 and i:
                refs.append(f"[F{rnd.randrange(max(0, i - 2), i)}]")
            else:
                refs.append(f"[F{rnd.randrange(n)}]")  # may close a cycle
        fields.append(calc(f"f{i}", f"F{i}", " + ".join(refs + [str(i)])))
    out, _ = resolve(frame, fields)
    want = brute(fields)
    for fid, (text, worst, deep) in want.items():
        assert out[fid].resolved_formula == text, fid
        assert (out[fid].resolution_status, out[fid].resolution_depth) == (graph.STATUS[worst], deep + 1), fid


def brute_components(edges):
    reach = {}
    nodes = {x for e in edges for x in e}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[n] = seen
    return {n: frozenset(m for m in nodes if m == n or (m in reach[n] and n in reach[m])) for n in nodes}


def test_strong_components_match_brute_force(frame):
    rnd = random.Random(7)
    edges = []
    for part in range(6):  # from sparse to dense, a long ring, a chain between the parts
        n = 9
        edges += [(f"p{part}n{rnd.randrange(n)}", f"p{part}n{rnd.randrange(n)}") for _ in range(n + 2 * part)]
    edges += [(f"r{i}", f"r{(i + 1) % 15}") for i in range(15)] + [("p0n1", "p1n1"), ("p1n1", "p2n1"), ("r3", "p4n4")]
    got = {r.id: (r.comp, r.members) for r in graph.strong_components(frame("node string, child string", edges)).collect()}
    want = {n: c for n, c in brute_components(edges).items() if len(c) > 1}
    assert got.keys() == want.keys()
    for n, c in want.items():
        assert got[n][1] == len(c) and all(got[m][0] == got[n][0] for m in c) and got[n][0] in c


def test_a_clique_finishes_and_counts_its_members(frame):
    clique = [calc(f"k{i:02}", f"K{i}", " + ".join(f"[K{j}]" for j in range(20) if j != i) + " + [Leaf]") for i in range(20)]
    out, _ = resolve(frame, clique + [calc("leaf", "Leaf", "1"), calc("up", "Up", "[K3] * [Leaf]"), calc("two", "Two", "[Up] + [Two]")])
    assert {out[f"k{i:02}"].resolution_status for i in range(20)} == {"cycle"} == {out["up"].resolution_status, out["two"].resolution_status}
    assert out["k03"].resolved_formula.endswith("[K19] + (1)") and out["up"].resolved_formula == f"({out['k03'].resolved_formula}) * (1)"
    assert {out[f"k{i:02}"].resolution_depth for i in range(20)} == {14}  # twenty members reach the cap
    small = [calc(f"t{i}", f"T{i}", " + ".join(f"[T{j}]" for j in range(3) if j != i)) for i in range(3)]
    out, _ = resolve(frame, small + [calc("v", "V", "[T0] + [W]"), calc("w", "W", "2")])
    assert (out["t0"].resolution_depth, out["v"].resolution_depth) == (4, 5)
    assert out["v"].resolved_formula == "([T1] + [T2]) + (2)"


def chain_tables(frame, edges):
    return {"lineage": frame("downstream_type string, downstream_id string, upstream_type string, upstream_id string",
                             [("datasource", a, "datasource", b) for a, b in edges])}


@pytest.mark.parametrize("edges, depth", [
    ([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], 3),
    ([("a", "a")], 1),
    ([("a", "b"), ("b", "a")], 1),
    ([("x", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], 4),
    ([("a", "b"), ("b", "c"), ("c", "a")], 2),
    ([("a", "x")], 1),
])
def test_source_chains(frame, edges, depth):
    assert graph.source_chain_depth(chain_tables(frame, edges)).first().depth == depth


def test_source_chain_of_nothing(frame):
    assert graph.source_chain_depth(chain_tables(frame, [("a", "b")])).first().depth == 1
    empty = {"lineage": chain_tables(frame, [("a", "b")])["lineage"].filter("false")}
    assert graph.source_chain_depth(empty).first().depth == 0
