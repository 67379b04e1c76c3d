"""Reference binding, formula closure and expansion, source chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_audit.functions import formula as fx
from catalog_audit.session import materialize, materialize_counted

MAX_DEPTH = 12
STATUS = ["resolved", "unresolved_reference", "too_deep", "cycle"]  # worst last


def name_index(tables) -> DataFrame:
    """One row per (source, lookup key); a key naming two fields is ambiguous."""
    fields = tables["fields"]
    names = [fields.select("datasource_id", "id", "is_calculated", F.col("name").alias("label"))]
    if "caption" in fields.columns:
        names.append(fields.select("datasource_id", "id", "is_calculated", F.col("caption").alias("label")))
    keyed = reduce(DataFrame.unionByName, names).filter("label IS NOT NULL AND label <> ''")
    return (keyed.groupBy("datasource_id", fx.reference_key(F.col("label")).alias("key"))
            .agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.bool_or("is_calculated").alias("calc")))


def token_bind(tables) -> DataFrame:
    """Each bracket token of each calculated field, bound inside its own source."""
    tokens = (tables["fields"].filter("is_calculated")
              .select(F.col("id").alias("field_id"), "datasource_id", F.posexplode(fx.bracket_refs(F.col("formula"))))
              .withColumnRenamed("col", "token")
              .withColumn("key", fx.reference_key(F.expr("substring(token, 2, length(token) - 2)"))))
    unique = F.col("lo") == F.col("hi")
    return tokens.join(name_index(tables), ["datasource_id", "key"], "left").select(
        "field_id", "pos", "token",
        F.when(unique, F.col("lo")).alias("ref_id"),
        F.when(unique, F.col("calc")).alias("ref_calc"),
        F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("ambiguous"))


def reference_edges(tables) -> DataFrame:
    return tables["bindings"].filter("ref_id IS NOT NULL").select(
        "field_id", F.col("ref_id").alias("referenced_field_id")).distinct()


def ambiguous_refs(tables) -> DataFrame:
    b = tables["bindings"]
    return b.agg(F.count_if("ambiguous").alias("ambiguous_refs"), F.count(F.lit(1)).alias("tokens"),
                 F.count_if(F.col("ref_id").isNull()).alias("unbound_refs"))


def _spliced(formula: Column, texts: Column) -> Column:
    """``formula`` with token ``i`` replaced by ``(texts[i])`` where the map has it."""
    tokens = F.transform(fx.bracket_refs(formula), lambda t, i: F.coalesce(
        F.concat(F.lit("("), F.try_element_at(texts, i), F.lit(")")), t))
    literals = F.split(formula, fx.REFERENCE, -1)
    tail = F.slice(literals, F.lit(2), F.size(tokens))
    return F.concat(F.get(literals, F.lit(0)), F.array_join(F.zip_with(tokens, tail, lambda t, s: F.concat(t, s)), ""))


def strong_components(edges: DataFrame, a: str = "node", b: str = "child") -> DataFrame:
    """(id, comp, members): every vertex that lies on a cycle of more than one vertex, by its component.

    Vertices without a way in or out are trimmed. Of the rest, each takes the largest id that reaches it; those that
    also reach back to the vertex of that id inside its colour are one component. Edges between colours never lie on a
    cycle and leave with the components found; what remains is coloured again. Rounds follow the longest shortest way, not the number of paths.
    """
    alive, size = materialize_counted(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").distinct(), "arcs")
    found = []
    while size["rows"]:
        kept, got = materialize_counted(
            alive.join(alive.select(F.col("y").alias("x")).distinct(), "x", "left_semi")
            .join(alive.select(F.col("x").alias("y")).distinct(), "y", "left_semi").select("x", "y"), "arcs")
        trimmed = got["rows"] < size["rows"]
        alive, size = kept, got
        if trimmed:
            continue
        colors = alive.select(F.col("x").alias("id"), F.col("x").alias("color")).distinct()
        moved = {"moved": 1}
        while moved["moved"]:
            offered = alive.join(colors.select(F.col("id").alias("x"), "color"), "x").groupBy(F.col("y").alias("id")).agg(F.max("color").alias("offered"))
            step = colors.join(offered, "id", "left").select("id", F.greatest("color", "offered").alias("color"), F.coalesce(F.col("offered") > F.col("color"), F.lit(False)).alias("moved"))
            stored, moved = materialize_counted(step, "colors", moved=F.count_if("moved"))
            colors = stored.drop("moved")
        own = alive.join(colors.select(F.col("id").alias("x"), "color"), "x").join(colors.select(F.col("id").alias("y"), F.col("color").alias("to")), "y")
        own = materialize(own.where("color = to").select("x", "y", "color"), "own-arcs")
        back = colors.where("id = color")
        front, more = back, {"rows": 1}
        while more["rows"]:
            before = own.join(front.select(F.col("id").alias("y")), "y").select(F.col("x").alias("id"), "color").distinct()
            front, more = materialize_counted(before.join(back, ["id", "color"], "left_anti"), "reaching")
            back = back.unionByName(front)
        back = materialize(back, "component")
        found.append(back)
        alive, size = materialize_counted(own.join(back.select(F.col("id").alias("x")), "x", "left_anti")
                                          .join(back.select(F.col("id").alias("y")), "y", "left_anti").select("x", "y"), "arcs")
    if not found:
        return alive.select(F.col("x").alias("id"), F.col("x").alias("comp"), F.lit(1).cast("bigint").alias("members")).where("false")
    every = reduce(DataFrame.unionByName, found).select("id", F.col("color").alias("comp"))
    sizes = every.groupBy("comp").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return every.join(sizes, "comp").select("id", "comp", "members")


def longest_ways(edges: DataFrame, lengths: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, height) over an acyclic graph (node, child): a vertex's own length, and one edge plus the height of its highest child.

    ``lengths`` (id, length) holds every vertex. One join per level; heights stop at ``limit``.
    """
    cut = (lambda c: F.least(c, F.lit(limit))) if limit is not None else lambda c: c
    arcs, size = materialize_counted(edges.select("node", "child").distinct(), "ways")
    done = materialize(lengths.join(arcs.select(F.col("node").alias("id")).distinct(), "id", "left_anti").select("id", cut(F.col("length")).alias("height")), "heights")
    waiting, pending = size["rows"], arcs
    while waiting:
        known = done.select(F.col("id").alias("child"), "height")
        ready = pending.join(known, "child", "left").groupBy("node").agg(
            F.bool_and(F.col("height").isNotNull()).alias("all_known"), F.max("height").alias("below"), F.count(F.lit(1)).alias("arcs")).where("all_known")
        new, got = materialize_counted(ready.join(lengths.withColumnRenamed("id", "node"), "node").select(
            F.col("node").alias("id"), cut(F.col("length") + 1 + F.col("below")).alias("height"), "arcs"), "heights", arcs=F.sum("arcs"))
        if not got["rows"]:
            raise ValueError("the graph has a cycle")
        waiting -= got["arcs"]
        done = done.unionByName(new.drop("arcs"))
        pending = pending.join(new.select(F.col("id").alias("node")), "node", "left_anti")
    return done


def resolve_formulas(tables, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Expanded text, status and depth of every calculated field.

    A field whose calculated references are all finished is finished too: one join per
    level, every field expanded once whatever number of formulas share it. What reaches
    a cycle or lies above ``max_depth`` is expanded level by level from the top, each
    field once per level (``_unroll``).

    A *ring*, a component in which every field refers to one other of it, is
    unrolled once around from the field where it is entered. In any other component (a *tangle*) the ways around
    multiply with every reference: there a reference to a field of the same
    component stays as written, the status is ``cycle``, and the depth counts all members of the
    component and the longest way that leads on from any of them.
    """
    bind = tables["bindings"]
    facts = bind.groupBy("field_id").agg(
        F.bool_or(F.col("ref_id").isNull()).alias("loose"), F.count_if("ref_calc").alias("n_calc"))
    calc = tables["fields"].filter("is_calculated").select(
        F.col("id").alias("field_id"), F.coalesce("formula", F.lit("")).alias("formula"))
    base, size = materialize_counted(calc.join(facts, "field_id", "left").select(
        "field_id", "formula", F.coalesce("loose", F.lit(False)).alias("loose"),
        F.coalesce("n_calc", F.lit(0)).alias("n_calc")), "formulas", parents=F.count_if(F.col("n_calc") > 0))
    uses = bind.filter("ref_calc").select("field_id", "pos", "ref_id")

    done = base.filter("n_calc = 0").select(
        "field_id", F.col("formula").alias("text"), F.lit(0).alias("height"), "loose")
    pending, waiting = uses, size["parents"]
    for level in range(1, max_depth + 1):
        if not waiting:
            break
        # only texts some waiting formula names are carried into the join
        known = done.select(F.col("field_id").alias("ref_id"), "text", "height", F.col("loose").alias("child_loose")).join(
            pending.select("ref_id").distinct(), "ref_id", "left_semi")
        ready = (pending.join(known, "ref_id", "left").groupBy("field_id").agg(
            F.bool_and(F.col("height").isNotNull()).alias("all_known"),
            (F.max("height") + 1).alias("height"), F.bool_or("child_loose").alias("child_loose"),
            # bounded by the tokens of one formula
            F.map_from_entries(F.collect_list(F.struct("pos", "text"))).alias("texts")).filter("all_known"))
        new, got = materialize_counted(ready.join(base, "field_id").select(
            "field_id", _spliced(F.col("formula"), F.col("texts")).alias("text"), "height",
            (F.col("loose") | F.col("child_loose")).alias("loose")), f"level-{level}")
        if not got["rows"]:
            break  # all that is left reaches a cycle
        done = done.unionByName(new)
        waiting -= got["rows"]
        pending = pending.join(new.select("field_id"), "field_id", "left_anti")

    closed = done.select("field_id", F.col("text").alias("resolved_formula"),
                         (F.col("height") + 1).cast("bigint").alias("resolution_depth"),
                         F.when(F.col("loose"), STATUS[1]).otherwise(STATUS[0]).alias("resolution_status"))
    if waiting:
        # one table instead of a union of levels: every level below joins it
        finished = materialize(done.select("field_id", "text", "height", "loose"), "finished")
        closed = closed.unionByName(_unroll(materialize(pending, "pending"), base, uses, finished, max_depth))
    norm = fx.normalize_formula(F.col("resolved_formula"))
    return (closed.withColumn("norm", norm)
            .withColumn("normalized_hash", fx.hash_normalized(F.col("norm"))))


def _cyclic_parts(pending: DataFrame, done: DataFrame, limit: int) -> DataFrame:
    """(node, comp, ring, members, height): fields on a cycle; ``height`` is the longest way from a tangle, each component counted whole."""
    arcs = materialize(pending.select(F.col("field_id").alias("node"), F.col("ref_id").alias("child")).distinct(), "references")
    parts = strong_components(arcs).select(F.col("id").alias("node"), "comp", "members")
    loops = arcs.where("node = child").select("node").join(parts, "node", "left_anti")
    parts = parts.unionByName(loops.select("node", F.col("node").alias("comp"), F.lit(1).cast("bigint").alias("members")))
    parts = materialize(parts, "components")
    of = parts.select("node", "comp")
    inside = arcs.join(of, "node").join(of.select(F.col("node").alias("child"), F.col("comp").alias("to")), "child").where("comp = to")
    shape = inside.groupBy("comp").agg(F.count(F.lit(1)).alias("arcs"))
    shaped, seen = materialize_counted(parts.join(shape, "comp").withColumn("ring", F.col("arcs") == F.col("members")), "shapes", tangled=F.count_if(F.col("arcs") > F.col("members")))
    if not seen["tangled"]:
        return shaped.select("node", "comp", "ring", "members", F.lit(0).cast("bigint").alias("height"))
    # longest ways over the condensation: a component is one vertex as long as it has members
    named = arcs.join(of.select("node", F.col("comp").alias("from")), "node", "left").join(
        of.select(F.col("node").alias("child"), F.col("comp").alias("to")), "child", "left").select(
        F.coalesce("from", "node").alias("node"), F.coalesce("to", "child").alias("child")).where("node <> child").distinct()
    ends = done.select(F.col("field_id").alias("id"), F.col("height").cast("bigint").alias("length"))
    whole = parts.select(F.col("comp").alias("id"), F.col("members").alias("length")).distinct()
    every = named.select(F.col("node").alias("id")).unionByName(named.select(F.col("child").alias("id"))).unionByName(whole.select("id")).distinct()
    lengths = every.join(ends.unionByName(whole), "id", "left").select("id", F.coalesce("length", F.lit(0)).alias("length"))
    heights = longest_ways(named, lengths, limit).select(F.col("id").alias("comp"), F.col("height").cast("bigint").alias("height"))
    return shaped.join(heights, "comp").select("node", "comp", "ring", "members", "height")


def _unroll(pending: DataFrame, base: DataFrame, uses: DataFrame, done: DataFrame, max_depth: int) -> DataFrame:
    """Expansion of fields that reach a cycle or lie too deep, level by level.

    What a field expands to depends on its level and, in a ring, on how many of the ring's members are still
    to come (``turn``), on nothing else: a level holds each (field, turn) once, whatever number of formulas lead there.
    """
    parts = materialize(_cyclic_parts(pending, done, max_depth + 1), "cyclic-parts")
    of = parts.select("node", "comp", "ring", "members")
    ways = uses.select(F.col("field_id").alias("node"), "pos", F.col("ref_id").alias("child")).join(
        of.select("node", "comp"), "node", "left").join(
        of.select(F.col("node").alias("child"), F.col("comp").alias("child_comp"), F.col("ring").alias("child_ring"), "members"), "child", "left")
    inside = F.coalesce(F.col("comp") == F.col("child_comp"), F.lit(False))
    ways = materialize(ways.withColumn("inside", inside).where("NOT (inside AND NOT child_ring)")
                       .select("node", "pos", "child", "inside", F.when(F.col("child_ring"), F.col("members")).otherwise(0).alias("entry")), "ways")
    turn = F.when(F.col("inside"), F.col("turn") - 1).otherwise(F.col("entry"))
    heights = done.select(F.col("field_id").alias("child"), "height", F.col("loose").alias("sub_loose"))

    top = pending.select(F.col("field_id").alias("node")).distinct().join(of, "node", "left")
    states = [materialize(top.select("node", F.when(F.col("ring"), F.col("members")).otherwise(0).alias("turn"), F.lit("open").alias("kind"),
                                     F.lit(0).alias("height"), F.lit(False).alias("sub_loose")), "unroll-0")]
    while True:
        depth = len(states)
        reached = states[-1].where("kind = 'open'").select("node", "turn").join(ways, "node").select("child", turn.alias("turn"), "inside").distinct()
        kind = (F.when(F.col("inside") & (F.col("turn") == 0), "cycle")
                .when(F.coalesce(F.col("height") <= max_depth - depth, F.lit(False)), "done")
                .when(F.lit(depth > max_depth), "too_deep").otherwise("open"))
        level, got = materialize_counted(reached.join(heights, "child", "left").select(
            F.col("child").alias("node"), "turn", kind.alias("kind"), "height", "sub_loose"), f"unroll-{depth}")
        if not got["rows"]:
            break
        states.append(level)

    raw = base.select(F.col("field_id").alias("node"), "formula", "loose")
    tangled = parts.where("NOT ring").select("node", F.col("height").alias("way"))
    below = None
    for depth in reversed(range(len(states))):
        level = states[depth].join(raw, "node").join(tangled, "node", "left")
        texts = done.select(F.col("field_id").alias("node"), "text")
        leaf = level.where("kind IN ('cycle', 'too_deep')").select(
            "node", "turn", F.col("formula").alias("text"), F.when(F.col("kind") == "cycle", 3).otherwise(2).alias("rank"), F.lit(depth).cast("bigint").alias("deepest"))
        folded = level.where("kind = 'done'").join(texts, "node").select(
            "node", "turn", "text", F.col("sub_loose").cast("int").alias("rank"), (F.lit(depth) + F.col("height")).cast("bigint").alias("deepest"))
        opened = level.where("kind = 'open'")
        own_rank = F.when(F.col("way").isNotNull(), 3).otherwise(F.col("loose").cast("int"))
        own_depth = F.least(F.lit(depth) + F.coalesce("way", F.lit(0)), F.lit(max_depth + 1)).cast("bigint")
        if below is None:
            opened = opened.select("node", "turn", F.col("formula").alias("text"), own_rank.alias("rank"), own_depth.alias("deepest"))
        else:
            placed = (opened.select("node", "turn").join(ways, "node").select("node", "turn", "pos", "child", turn.alias("child_turn"))
                      .join(below.select(F.col("node").alias("child"), F.col("turn").alias("child_turn"), "text", "rank", "deepest"), ["child", "child_turn"])
                      .groupBy("node", "turn").agg(
                          # bounded by the tokens of one formula
                          F.map_from_entries(F.collect_list(F.struct("pos", "text"))).alias("texts"), F.max("rank").alias("sub_rank"), F.max("deepest").alias("sub_deepest")))
            opened = opened.join(placed, ["node", "turn"], "left").select(
                "node", "turn", F.when(F.col("texts").isNull(), F.col("formula")).otherwise(_spliced(F.col("formula"), F.col("texts"))).alias("text"),
                F.greatest(own_rank, "sub_rank").alias("rank"), F.greatest(own_depth, "sub_deepest").alias("deepest"))
        below = materialize(leaf.unionByName(folded).unionByName(opened), "unrolled")
    return below.select(
        F.col("node").alias("field_id"), F.col("text").alias("resolved_formula"), (F.col("deepest") + 1).alias("resolution_depth"),
        F.element_at(F.array(*map(F.lit, STATUS)), F.col("rank") + 1).alias("resolution_status"))


def resolution_status_counts(tables) -> DataFrame:
    return tables["resolved"].groupBy("resolution_status").agg(F.count(F.lit(1)).alias("fields"))


def source_chain_depth(tables) -> DataFrame:
    """Longest source-on-source chain in edges.

    Sources that feed one another in circles are one component. The longest way goes over the components, each passed
    through all its members once, with one more step for a source that feeds itself.
    """
    edges = materialize(tables["lineage"].filter("downstream_type = 'datasource' AND upstream_type = 'datasource'")
                        .select(F.col("downstream_id").alias("node"), F.col("upstream_id").alias("child")).distinct(), "chains")
    parts = materialize(strong_components(edges), "chain-components")
    of = parts.select(F.col("id").alias("node"), "comp")
    named = (edges.join(of.withColumnRenamed("comp", "from"), "node", "left")
             .join(of.select(F.col("node").alias("child"), F.col("comp").alias("to")), "child", "left"))
    ends = named.select(F.coalesce("from", "node").alias("id"), F.when(F.col("node") == F.col("child"), 1).otherwise(0).alias("loops"))
    ends = ends.unionByName(named.select(F.coalesce("to", "child").alias("id"), F.lit(0).alias("loops")))
    inner = parts.select(F.col("comp").alias("id"), (F.col("members") - 1).alias("inner")).distinct()
    lengths = ends.groupBy("id").agg(F.sum("loops").alias("loops")).join(inner, "id", "left").select("id", (F.col("loops") + F.coalesce("inner", F.lit(0))).alias("length"))
    arcs = named.select(F.coalesce("from", "node").alias("node"), F.coalesce("to", "child").alias("child")).where("node <> child")
    return longest_ways(arcs, materialize(lengths, "chain-lengths")).agg(F.coalesce(F.max("height"), F.lit(0)).cast("bigint").alias("depth"))
