"""Mixing sources to target weights, in DataFrame operations only.

Targets. Sources in code-point order (null last) have the weights 5, 2, 1 in turn and share
150 % of all words. A target stops at twice its source's words and the excess is reshared
by weight: the targets are min(2 * words, level * weight) with the one level that spends the
whole budget, found by running sums over the sources in the order in which they fill up.

Draws. A hash of doc_id and text puts a document at a point of [0, 1); equal cells of that
line are the source's blocks, in permuted order. Where more than 1 / ``HEAVY`` of a source's
rows or words share a point, being repeats of one row, they are numbered and get a point each. A source is drawn once whole if its target exceeds
its words; what is left to take is a stretch of the line from 0 to a cut. The cut is found by
summing words per cell and then per cell of the cell that it falls into, until that last
cell has few documents; of these the largest that still fit are taken.

Shards. Every drawn block goes to one output shard. A splitting tree halves the shards from
the root down; at each node a multivariate hypergeometric draw decides how many blocks of
each source go left (source by source, each count conditional on those before), so every
shard gets an exact quota of each source. The quotas are then filled with disjoint ranges of
the source's blocks in another permuted order, and ``position`` shuffles within a shard.

What is joined to the documents is one row per source of at most about 20 KB. Documents move
nowhere, but for numbered repeats, which are written once. Null texts have no words; null
doc_ids are a value like any other. Repeats of one row below 1 / ``HEAVY`` of their source are
taken or left together. No documents: no rows.
"""

from __future__ import annotations

from ebbtide.llm.scratch import hash_share, stored
from ebbtide.llm.words import word_count
from pyspark.sql import Column, DataFrame, Window, functions as F

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2
SHARDS = 16
#: Blocks of a source: a power of two, up to this one, with about 16 documents or more.
BLOCKS = 1024
BLOCK_ROWS = 16
#: The cut is refined until its cell has no more (point, size) groups than this.
POOL = 1024
FINER = 256
#: Up to so many sources their rows, 20 KB each at most, are broadcast.
FEW_SOURCES = 1024
#: Repeats above 1 / HEAVY of a source's rows or words are numbered: at most 2 * HEAVY a source.
HEAVY = 256
SLICES = 4096
#: Up to so many slices or points of some 30 bytes are broadcast.
FEW_POINTS = 200_000


def _points(docs: DataFrame, seed: int, keep: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(
        *[F.struct(*[docs[c] for c in keep]).alias("row")] if keep else [],
        docs["doc_id"].alias("id"), docs["source"].alias("source"),
        word_count(docs["text"]).alias("size"),
        hash_share(F.struct(docs["doc_id"].alias("id"), docs["text"].alias("text")), seed)
        .alias("at"))


def _heavy(points: DataFrame) -> DataFrame:
    """``(of, point)``: where many rows of a source share a point.

    Slices of the line are added up first; only rows of the slices that hold enough are
    counted by point.
    """
    slice_ = F.floor(F.col("at") * SLICES)
    measures = [F.count(F.lit(1)).alias("docs"), F.sum("size").alias("words")]
    total = points.groupBy("source").agg(*measures).select(
        F.col("source").alias("whose"), F.col("docs").alias("all_docs"),
        F.col("words").alias("all_words"))
    many = ((F.col("docs") > 1) & ((F.col("docs") * HEAVY > F.col("all_docs"))
                                   | (F.col("words") * HEAVY > F.col("all_words"))))

    def large(df: DataFrame, *keys: Column) -> DataFrame:
        sums = df.groupBy(F.col("source").alias("of"), *keys).agg(*measures)
        return sums.join(total, sums["of"].eqNullSafe(total["whose"])).where(many)

    slices = stored(large(points, slice_.alias("slice")).select("of", "slice"), "slices")
    near = F.broadcast(slices) if _few(slices, FEW_POINTS) else slices
    inside = points.join(near, _same_source(points, near) & (slice_ == near["slice"]), "left_semi")
    return stored(large(inside, F.col("at").alias("point")).select("of", "point"), "heavy")


def _numbered(wide: DataFrame, narrow: DataFrame, seed: int) -> list[DataFrame]:
    """Both tables, with the repeats of heavy points at points of their own. These rows are
    written once, so that both tables have the same points."""
    heavy = _heavy(narrow)
    if heavy.isEmpty():
        return [wide, narrow]
    pairs = F.broadcast(heavy) if _few(heavy, FEW_POINTS) else heavy

    def side(df: DataFrame, how: str) -> DataFrame:
        return df.join(pairs, _same_source(df, pairs) & (df["at"] == pairs["point"]), how)

    own = hash_share(F.struct(F.col("at"), F.monotonically_increasing_id().alias("number")), seed)
    hot = stored(side(wide, "left_semi").withColumn("at", own), "hot")
    return [side(df, "left_anti").unionByName(hot.select(*df.columns)) for df in (wide, narrow)]


def targets(points: DataFrame) -> DataFrame:
    """``(source, number, docs, words, target)``: one row per source."""
    sums = points.groupBy("source").agg(F.count(F.lit(1)).alias("docs"),
                                        F.sum("size").alias("words"))
    # From here on there is one row per source.
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    numbered = sums.withColumn("number", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.get(weights, F.col("number") % len(WEIGHTS)))
    fill = F.lit(MOST) * F.col("words") / F.col("weight")
    order = Window.orderBy("fill", "number")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.lit(BUDGET) * F.sum("words").over(every)
    full = F.coalesce(F.lit(MOST) * F.sum("words").over(earlier), F.lit(0))
    levels = numbered.withColumn("fill", fill).withColumn(
        "level", (budget - full) / F.sum("weight").over(later)).withColumn(
        "turn", F.row_number().over(order))
    # The first source, in the order of filling up, that its level does not fill.
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("turn", "level"))).over(every)
    return levels.withColumn("level", level["level"]).select(
        "source", "number", "docs", "words",
        F.least(F.col("weight") * F.col("level"), F.lit(MOST) * F.col("words")).cast("double")
        .alias("target"))


def _same_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["of"])


def _cuts(points: DataFrame, plan: DataFrame) -> DataFrame:
    """``(of, cut, width, rest)``: the cell in which each source's cut falls.

    All before ``cut`` is taken; ``rest`` words remain for the cell of that ``width``.
    """
    cells = plan.select(F.col("source").alias("of"), F.lit(0.0).alias("cut"),
                        F.lit(1.0).alias("width"), F.col("besides").alias("rest"),
                        F.col("blocks").cast("double").alias("parts"))
    while True:
        inside = points.join(F.broadcast(cells) if _few(plan) else cells,
                             _same_source(points, cells)
                             & (F.col("at") >= F.col("cut"))
                             & (F.col("at") < F.col("cut") + F.col("width")))
        part = F.floor((F.col("at") - F.col("cut")) / F.col("width") * F.col("parts"))
        sums = inside.groupBy("of", "cut", "width", "rest", "parts", part.alias("part")).agg(
            F.sum("size").alias("words"), F.count_distinct("at", "size").alias("groups"))
        run = Window.partitionBy("of").orderBy("part")
        upto = sums.withColumn("upto", F.sum("words").over(run))
        # The first part that exceeds the rest; beyond the last part if none does.
        falls = upto.where(F.col("upto") > F.col("rest")).groupBy("of").agg(
            F.min(F.struct("part", "upto", "words", "groups", "cut", "width", "rest", "parts"))
            .alias("f"))
        narrower = stored(falls.select(
            "of", (F.col("f.cut") + F.col("f.width") / F.col("f.parts") * F.col("f.part"))
            .alias("cut"), (F.col("f.width") / F.col("f.parts")).alias("width"),
            (F.col("f.rest") - F.col("f.upto") + F.col("f.words")).alias("rest"),
            F.lit(float(FINER)).alias("parts"), F.col("f.groups").alias("groups")), "cuts")
        # A cell of one hash value cannot be cut further.
        if narrower.where((F.col("groups") > POOL) & (F.col("width") > 2.0**-44)).isEmpty():
            return narrower
        cells = narrower.drop("groups")


def _few(plan: DataFrame, most: int | None = None) -> bool:
    return plan.count() <= (FEW_SOURCES if most is None else most)


def _picks(points: DataFrame, cuts: DataFrame, few: bool) -> DataFrame:
    """``(of, picks)``: of the cell at the cut, the largest documents that still fit, one by
    one; and at the end the smallest of the others if that comes nearer."""
    pool = points.join(F.broadcast(cuts) if few else cuts, _same_source(points, cuts)
                       & (F.col("at") >= F.col("cut"))
                       & (F.col("at") < F.col("cut") + F.col("width")))
    one = pool.where("size > 0").groupBy("of", "rest", "at", "size").agg(
        F.sum("size").alias("words"))
    listed = one.groupBy("of", "rest").agg(F.sort_array(F.collect_list(
        F.struct("words", "at", "size")), asc=False).alias("pool"))
    taken = F.expr("""aggregate(pool,
        named_struct('left', rest, 'taken', filter(pool, p -> false), 'next', element_at(pool, 1)),
        (s, p) -> if(p.words <= s.left,
            named_struct('left', s.left - p.words, 'taken', array_append(s.taken, p),
                         'next', s.next),
            named_struct('left', s.left, 'taken', s.taken, 'next', p)))""")
    nearer = F.expr("next_is_left AND s.next.words - s.left < s.left")
    return (listed.withColumn("s", taken)
            .withColumn("next_is_left", ~F.expr("array_contains(s.taken, s.next)"))
            .withColumn("chosen", F.when(nearer, F.array_append("s.taken", F.col("s.next")))
                        .otherwise(F.col("s.taken")))
            .select("of", F.expr("transform(chosen, p -> struct(p.at, p.size))").alias("picks")))


# One hypergeometric number: of q.n draws from q.total blocks, how many are among q.k.
# Inverse distribution function by the ratio of neighbouring probabilities, on the stretch
# of 12 standard deviations around the mode; what lies outside is below 1e-30. The weights of
# the stretch are added up once, and once more until the drawn share of their sum is reached.
def _ratio(p: str) -> str:
    return f"(({p}.k - j) * ({p}.n - j) / ((j + 1D) * ({p}.total - {p}.k - {p}.n + j + 1)))"


_DRAW = f"""transform(array(named_struct('total', q.total, 'k', q.k, 'n', q.n, 'u', q.u,
      'a', greatest(0L, q.n - q.total + q.k, q.mode - q.reach),
      'b', least(q.k, q.n, q.mode + q.reach))), r ->
    transform(array(named_struct('total', r.total, 'k', r.k, 'n', r.n, 'a', r.a, 'b', r.b,
        'aim', r.u * aggregate(sequence(r.a, r.b), named_struct('w', 1D, 'sum', 0D),
          (t, j) -> named_struct('w', t.w * {_ratio('r')}, 'sum', t.sum + t.w), t -> t.sum))), p ->
      aggregate(sequence(p.a, p.b), named_struct('w', 1D, 'sum', 0D, 'x', p.a),
        (s, j) -> named_struct('w', s.w * {_ratio('p')}, 'sum', s.sum + s.w,
          'x', if(s.sum + s.w < p.aim, least(j + 1, p.b), s.x)), s -> s.x))[0])[0]"""


def _halves(nodes: DataFrame, seed: int) -> DataFrame:
    """Split each node's shards in two and its blocks by a multivariate draw."""
    half = nodes.where("size > 1").selectExpr(
        "first", "size", "counts", "size div 2 AS left_size",
        "aggregate(counts, 0L, (s, k) -> s + k) AS total")
    half = half.withColumn("drawn", F.expr("total * left_size div size"))
    step = f"""transform(array(named_struct('total', s.total, 'k', counts[i], 'n', s.n,
          'u', shiftrightunsigned(xxhash64({seed}, first, size, i), 11) * {2.0**-53!r}D,
          'mode', CAST(floor((counts[i] + 1D) * (s.n + 1D) / (s.total + 2D)) AS BIGINT),
          'reach', CAST(12 + ceil(12 * sqrt(CAST(s.n AS DOUBLE) * counts[i]
              / greatest(s.total, 1L) / greatest(s.total, 1L) * (s.total - counts[i])
              * (s.total - s.n) / greatest(s.total - 1, 1L))) AS BIGINT))), q ->
        transform(array({_DRAW}), x -> named_struct('total', s.total - q.k, 'n', s.n - x,
          'xs', array_append(s.xs, x)))[0])[0]"""
    drawn = half.withColumn("xs", F.expr(
        f"""aggregate(sequence(0, size(counts) - 1),
              named_struct('total', total, 'n', drawn, 'xs', array_remove(array(0L), 0L)),
              (s, i) -> {step}, s -> s.xs)"""))
    split = drawn.selectExpr("""inline(array(
        named_struct('first', first, 'size', left_size, 'counts', xs),
        named_struct('first', first + left_size, 'size', size - left_size,
                     'counts', transform(counts, (k, i) -> k - xs[i]))))""")
    return split.unionByName(nodes.where("size = 1"))


def quotas(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(shard, number, quota)``: how many drawn blocks of each source a shard gets.

    ``plan`` has a row ``(number, drawn)`` per source, numbered from 0.
    """
    nodes = plan.agg(F.sort_array(F.collect_list(F.struct("number", "drawn"))).alias("s")).select(
        F.lit(0).alias("first"), F.lit(shards).alias("size"),
        F.col("s.drawn").alias("counts")).where(F.size("counts") > 0)
    for _ in range((shards - 1).bit_length()):
        nodes = stored(_halves(nodes, seed), "nodes")
    return nodes.select(F.col("first").alias("shard"),
                        F.posexplode("counts").alias("number", "quota"))


def _dealt(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(number, base, extra)``: the shard of each block in the whole draw and in the other."""
    filled = Window.partitionBy("number").orderBy("shard")
    ranges = quotas(plan.select("number", "drawn"), shards, seed).withColumn(
        "upto", F.sum("quota").over(filled))
    draws = plan.select("number", F.explode(F.expr(
        "concat(transform(sequence(0L, blocks - 1), b -> named_struct('turn', 0, 'block', b)),"
        " transform(sequence(0L, blocks - 1), b -> named_struct('turn', 1, 'block', b)))"))
        .alias("d"), "whole", "ahead").select("number", "d.turn", "d.block", "whole", "ahead")
    draws = draws.where("(turn = 0 AND whole) OR (turn = 1 AND block < ahead)")
    permuted = Window.partitionBy("number").orderBy(
        F.xxhash64(F.lit(seed + 1), "number", "turn", "block"), "turn", "block")
    ranked = draws.withColumn("rank", F.row_number().over(permuted))
    ends = ranges.groupBy("number").agg(F.sort_array(F.collect_list(
        F.struct("upto", "shard"))).alias("ends"))
    shard = F.expr("filter(ends, e -> e.upto >= rank)[0].shard")
    placed = ranked.join(ends, "number").select("number", "turn", "block", shard.alias("shard"))
    by_block = F.sort_array(F.collect_list(F.struct("block", "shard")))
    per_turn = placed.groupBy("number", "turn").agg(by_block["shard"].alias("shards"))
    return per_turn.groupBy("number").agg(
        F.max(F.when(F.col("turn") == 0, F.col("shards"))).alias("base"),
        F.max(F.when(F.col("turn") == 1, F.col("shards"))).alias("extra"))


def plan(points: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """One row per source: target, blocks, where its cut lies and where its blocks go."""
    blocks = F.least(F.lit(float(BLOCKS)), F.pow(F.lit(2.0), F.ceil(F.log2(
        F.greatest(F.col("docs") / BLOCK_ROWS, F.lit(1.0))))))
    whole = F.col("target") >= F.col("words")
    first = stored(targets(points).withColumn("blocks", blocks.cast("long"))
                   .withColumn("whole", whole & (F.col("words") > 0))
                   .withColumn("besides", F.col("target") - F.when(whole, F.col("words"))
                               .otherwise(0)), "targets")
    few = _few(first)
    cuts = _cuts(points, first)
    picks = _picks(points, cuts, few)
    ends = cuts.select("of", "cut", "width").join(
        picks.withColumnRenamed("of", "with"), F.col("of").eqNullSafe(F.col("with")), "left")
    # A source whose cut falls beyond its last document has none: it is taken to the end.
    known = first.join(ends, first["source"].eqNullSafe(ends["of"]), "left").select(
        "source", "number", "words", "target", "blocks", "whole",
        F.coalesce("cut", F.lit(1.0)).alias("cut"), F.coalesce("width", F.lit(0.0)).alias("width"),
        "picks")
    ahead = F.least(F.col("blocks"), F.floor(F.col("cut") * F.col("blocks"))
                    + F.when(F.col("cut") < 1, 1).otherwise(0))
    known = stored(known.withColumn("ahead", ahead).withColumn(
        "drawn", F.col("ahead") + F.when(F.col("whole"), F.col("blocks")).otherwise(0)), "known")
    dealt = _dealt(known, shards, seed)
    return stored(known.join(dealt, "number", "left").select(
        F.col("source").alias("of"), "words", "target", "blocks", "whole", "cut", "width",
        "picks", "base", "extra"), "plan")


def drawn(docs: DataFrame, keep: list[str], shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """``(row, id, at, size, words, target, base, extra)`` per document.

    ``row`` has the columns to keep, ``at`` is its point; ``base`` and ``extra`` are the shards it is drawn into,
    with its whole source and with what is taken besides; null where it is not.
    """
    points, narrow = _numbered(_points(docs, seed, tuple(keep)),
                               stored(_points(docs, seed), "points"), seed)
    by_source = plan(narrow, shards, seed)
    joined = points.join(F.broadcast(by_source) if _few(by_source) else by_source,
                         _same_source(points, by_source))
    block = F.floor(F.col("at") * F.col("blocks")).cast("int")
    picked = F.expr("CASE WHEN at < cut THEN true WHEN at < cut + width THEN "
                    "coalesce(array_contains(picks, struct(at, size)), false) ELSE false END")
    return joined.select(
        "row", "id", "at", "size", "words", "target",
        F.when(F.col("whole"), F.get("base", block)).alias("base"),
        F.when(picked, F.get("extra", block)).alias("extra"))


def _draws(docs: DataFrame, keep: list[str], shards: int, seed: int) -> DataFrame:
    """``(row, at, shard)``: a row for every draw of a document."""
    return drawn(docs, keep, shards, seed).select("row", "at", F.explode(
        F.filter(F.array("base", "extra"), F.isnotnull)).alias("shard"))


def mixed(docs: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """The mix: a row for every draw of a document, with its output ``shard`` and a
    ``position`` by which a reader of the shard sorts to shuffle it.

    Columns of the documents that are called shard or position are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in ("shard", "position")]
    return _draws(docs, keep, shards, seed).select(
        *[F.col("row")[c].alias(c) for c in keep], "shard",
        F.xxhash64(F.lit(seed + 2), "at", "shard").alias("position"))


def repeated(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix with the columns of the documents only."""
    return _draws(docs, docs.columns, SHARDS, seed).select(
        *[F.col("row")[c].alias(c) for c in docs.columns])
