"""Thread reconstruction: ids, reply graph closure, roots, conversations.

Iterative operators (closure, roots) expand only a frontier per round and cut
lineage with a reliable checkpoint in `spark.checkpoint.dir` every round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.functions.text import col, strip_ws
from ticketlake.operators.components import components
from ticketlake.session import cut_lineage

ID_PATTERN = r"^(\d+)(?:\.0+)?$"


# ------------------------------------------------------------------ B1 / B2

def normalise_id(c: str | Column) -> Column:
    """Number-or-string id -> digits string; anything else (or null) -> ''."""
    return F.coalesce(F.regexp_extract(F.trim(col(c)), ID_PATTERN, 1), F.lit(""))


def normalise_id_list(c: str | Column) -> Column:
    """Comma list of ids -> comma list of normalised ids (bad ones dropped)."""
    items = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda x: normalise_id(x))
    return F.array_join(F.filter(items, lambda x: x != ""), ",")


def parse_timestamp(c: str | Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """One fixed format; anything else -> null (TIMESTAMP_NTZ). The tolerant
    parse only guards validity; the value comes from the zone-free NTZ parse,
    evaluated only for parseable rows, so no session time zone can shift it."""
    ok = F.try_to_timestamp(col(c), F.lit(fmt)).isNotNull()
    return F.when(ok, F.to_timestamp_ntz(col(c), F.lit(fmt)))


def normalise_tweets(raw: DataFrame, fmt: str = "yyyy-MM-dd HH:mm:ss",
                     coerce_child_lists: bool = False) -> DataFrame:
    """Typed tweets: ids as digit strings ('' when missing), parsed time.
    `coerce_child_lists=True` reproduces the numeric coercion that turns any
    multi-child list into ''."""
    kids = normalise_id(F.col("response_tweet_id")) if coerce_child_lists \
        else normalise_id_list(F.col("response_tweet_id"))
    return raw.withColumns({
        "tweet_id": normalise_id("tweet_id"),
        "in_response_to_tweet_id": normalise_id("in_response_to_tweet_id"),
        "response_tweet_id": kids,
        "created_at": parse_timestamp("created_at", fmt),
    })


# ------------------------------------------------------------------ B3-B9

def brand_responses(tweets: DataFrame, brand: str) -> DataFrame:
    return tweets.filter((F.col("author_id") == brand) & ~F.col("inbound"))


def reply_pairs(tweets: DataFrame, brand: str) -> DataFrame:
    """(response_id, query_id, user_query, response): brand replies joined to
    the customer tweets they answer; row multiplicity kept. Blank ids answer
    nothing."""
    resp = brand_responses(tweets, brand).filter(F.col("in_response_to_tweet_id") != "").select(
        F.col("tweet_id").alias("response_id"),
        F.col("in_response_to_tweet_id").alias("query_id"),
        F.col("text").alias("response"))
    cust = tweets.join(resp.select(F.col("query_id").alias("tweet_id")), "tweet_id", "left_semi") \
        .select(F.col("tweet_id").alias("query_id"), F.col("text").alias("user_query"))
    return resp.join(cust, "query_id", "inner").select("response_id", "query_id", "user_query", "response")


def child_ids(c: str | Column) -> Column:
    """Comma list -> array of trimmed, non-empty ids."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda x: F.trim(x)),
                    lambda x: x != "")


def explode_children(tweets: DataFrame) -> DataFrame:
    return tweets.select("tweet_id", F.explode(child_ids("response_tweet_id")).alias("child_id"))


def neighbours(tweets: DataFrame) -> DataFrame:
    """(src, nbr): parent and every listed child of each tweet."""
    parent = F.when(F.col("in_response_to_tweet_id") != "",
                    F.array(F.col("in_response_to_tweet_id"))).otherwise(F.array().cast("array<string>"))
    return tweets.select(F.col("tweet_id").alias("src"),
                         F.explode(F.array_union(parent, child_ids("response_tweet_id"))).alias("nbr"))


def brand_seed_ids(tweets: DataFrame, brand: str) -> DataFrame:
    """Brand tweet ids U their parents U their children (distinct `id`)."""
    brand_rows = tweets.filter(F.col("author_id") == brand)
    own = brand_rows.select(F.col("tweet_id").alias("id"))
    nb = neighbours(brand_rows).select(F.col("nbr").alias("id"))
    return own.union(nb).distinct()


# ------------------------------------------------------------------ B10

def _closure_frontier(tweets: DataFrame, brand: str) -> DataFrame:
    """Tweets reachable from the brand seed by repeatedly adding parents and
    children of every *existing* tweet in the set (ids that have no row are
    kept in the set but not expanded). Only the frontier is expanded. The
    caller passes a materialised tweet table (read by the seed, the edges and
    the final filter)."""
    nbr = neighbours(tweets).persist()
    seen = cut_lineage(brand_seed_ids(tweets, brand))
    frontier = seen
    while True:         # ends: every round adds ids of the dump
        new = (frontier.join(nbr, frontier.id == nbr.src, "inner")
                       .select(F.col("nbr").alias("id")).distinct()
                       .join(seen, "id", "left_anti"))
        new = cut_lineage(new)
        if new.isEmpty():
            break
        seen = cut_lineage(seen.union(new))
        frontier = new
    nbr.unpersist()
    return tweets.join(seen.withColumnRenamed("id", "tweet_id"), "tweet_id", "left_semi")


def _closure_contracted(tweets: DataFrame, brand: str) -> DataFrame:
    """The closure of a dump with some inconsistent edges: tweets joined by
    edges that both ends state are one component and reached together, so the
    frontier walks components, and only over the edges that one end states."""
    ids = tweets.select(F.col("tweet_id").alias("nbr")).distinct()
    edges = cut_lineage(neighbours(tweets).distinct().join(ids, "nbr", "left_semi").select("src", "nbr"))
    back = edges.select(F.col("nbr").alias("src"), F.col("src").alias("nbr"))
    roots = components(edges.join(back, ["src", "nbr"], "left_semi"), "src", "nbr")
    comp = cut_lineage(ids.join(roots, ids.nbr == roots.node, "left")
                          .select(F.col("nbr").alias("id"), F.coalesce("root", "nbr").alias("comp")))
    one_way = edges.join(back, ["src", "nbr"], "left_anti")
    to = comp.select(F.col("id").alias("nbr"), F.col("comp").alias("to"))
    steps = cut_lineage(one_way.join(comp.withColumnRenamed("id", "src"), "src").join(to, "nbr")
                               .select("comp", "to").filter("comp <> to").distinct())
    seen = cut_lineage(brand_seed_ids(tweets, brand).join(comp, "id").select("comp").distinct())
    frontier = seen
    while True:         # ends: every round adds components
        new = cut_lineage(frontier.join(steps, "comp").select(F.col("to").alias("comp")).distinct()
                                  .join(seen, "comp", "left_anti"))
        if new.isEmpty():
            break
        seen = cut_lineage(seen.union(new))
        frontier = new
    keep = comp.join(seen, "comp", "left_semi").select(F.col("id").alias("tweet_id"))
    return tweets.join(keep, "tweet_id", "left_semi")


def edges_consistent(tweets: DataFrame) -> bool:
    """True when, between existing tweets, every listed child points back to
    its lister and every parent pointer is listed by the parent: then reply
    edges are symmetric and reachability equals connectivity."""
    ids = tweets.select(F.col("tweet_id").alias("c"))
    listed = (explode_children(tweets).select(F.col("tweet_id").alias("x"), F.col("child_id").alias("c"))
              .join(ids, "c", "left_semi").distinct().withColumn("l", F.lit(True)))
    pointed = (tweets.filter(F.col("in_response_to_tweet_id") != "")
               .select(F.col("in_response_to_tweet_id").alias("x"), F.col("tweet_id").alias("c"))
               .join(ids.select(F.col("c").alias("x")), "x", "left_semi").distinct().withColumn("p", F.lit(True)))
    j = listed.join(pointed, ["x", "c"], "full_outer")
    return j.filter(F.col("l").isNull() | F.col("p").isNull()).isEmpty()


def _cycle_labels(parents: DataFrame, rooted: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(root_id, comp): a root on a cycle (its own root, yet it has an
    existing parent other than itself) gets the smallest id of its cycle, by
    min-doubling along the cycle; other roots label themselves."""
    p = parents.select(F.col("tweet_id").alias("node"), F.col("in_response_to_tweet_id").alias("parent"))
    roots = rooted.select(F.col("root_id").alias("node")).distinct()
    on_cycle = (roots.join(p, "node")
                .join(p.select(F.col("node").alias("parent")), "parent", "left_semi")
                .filter(F.col("parent") != F.col("node")))
    cur = cut_lineage(on_cycle.select("node", F.col("parent").alias("ptr"), F.col("node").alias("m")))
    for _ in range(max_rounds):
        a, b = cur.alias("a"), cur.alias("b")
        nxt = cut_lineage(a.join(b, F.col("a.ptr") == F.col("b.node")).select(
            F.col("a.node").alias("node"), F.col("b.ptr").alias("ptr"),
            F.least(F.col("a.m"), F.col("b.m")).alias("m")))
        changed = nxt.join(cur.select("node", F.col("m").alias("m0")), "node").filter(F.col("m") != F.col("m0"))
        cur = nxt
        if changed.isEmpty():
            break
    else:
        raise RuntimeError(f"cycle labels did not settle in {max_rounds} rounds")
    labels = cur.select(F.col("node").alias("root_id"), F.col("m").alias("comp"))
    return (roots.select(F.col("node").alias("root_id")).join(labels, "root_id", "left")
                 .select("root_id", F.coalesce("comp", "root_id").alias("comp")))


def thread_closure(tweets: DataFrame, brand: str, method: str = "auto",
                   with_roots: bool = False) -> DataFrame:
    """Tweets reachable from the brand seed (brand tweets, their parents and
    children) by repeatedly adding parents and listed children of existing
    tweets.

    method="frontier": one join round per hop (rounds = graph diameter).
    method="components": for consistent dumps, the union of reply-graph
    components holding a brand tweet: pointer-doubling roots, cycles labelled
    by their smallest id, O(log depth) rounds. "auto" checks consistency
    with one edge join and picks components when it holds; otherwise the
    consistent part is contracted and only its other edges are walked.
    `with_roots=True` adds `root_id` (the parent-walk root within the
    closure), reusing the component path's roots: every existing parent of a
    closure member is itself in the closure."""
    tweets = cut_lineage(tweets)
    if method == "frontier" or (method == "auto" and not edges_consistent(tweets)):
        rel = cut_lineage((_closure_frontier if method == "frontier" else _closure_contracted)(tweets, brand))
        return rel.join(thread_roots(rel), "tweet_id") if with_roots else rel
    rooted = cut_lineage(thread_roots(tweets))
    comp = rooted.join(_cycle_labels(tweets, rooted), "root_id").select("tweet_id", "root_id", "comp")
    hit = comp.join(tweets.filter(F.col("author_id") == brand).select("tweet_id"), "tweet_id", "left_semi") \
              .select("comp").distinct()
    keep = comp.join(hit, "comp", "left_semi").select("tweet_id", "root_id")
    return tweets.join(keep, "tweet_id") if with_roots else tweets.join(keep.select("tweet_id"), "tweet_id", "left_semi")


# ------------------------------------------------------------------ B11

def _double(p: DataFrame, max_rounds: int) -> tuple[DataFrame, bool]:
    """Pointer doubling on (node, ptr, done). Returns (pointers, has_cycles).
    `done` means ptr is a true root. Stops when nothing is pending, or when
    both the pending count and the set of pending targets stop shrinking
    (then every pending target lies on a cycle)."""
    last = None
    for _ in range(max_rounds):
        stats = p.filter(~F.col("done")).agg(F.count(F.lit(1)).alias("n"),
                                              F.count_distinct("ptr").alias("img")).first()
        cur = (stats["n"], stats["img"])
        if cur[0] == 0:
            return p, False
        if last is not None and cur == last:
            return p, True
        last = cur
        pend = p.filter(~F.col("done")).alias("a")
        b = p.alias("b")
        stepped = pend.join(b, F.col("a.ptr") == F.col("b.node"), "inner").select(
            F.col("a.node").alias("node"), F.col("b.ptr").alias("ptr"), F.col("b.done").alias("done"))
        p = cut_lineage(p.filter(F.col("done")).union(stepped))
    raise RuntimeError("pointer doubling did not converge")


def thread_roots(related: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(tweet_id, root_id): follow parents while the parent is in the set; on
    a cycle, a node on the cycle is its own root and a tail node's root is
    the cycle entry (first node revisited by the parent walk). An id of
    several rows has one parent: the greatest, so any before none. Rows
    without a parent, a third of a dump or more, take no part in the join."""
    nodes = (related.groupBy(F.col("tweet_id").alias("node"))
                    .agg(F.max(F.coalesce("in_response_to_tweet_id", F.lit(""))).alias("parent")))
    nodes = cut_lineage(nodes)
    ids = nodes.select(F.col("node").alias("pid"))
    child = nodes.filter("parent <> ''")
    base = (child.join(ids, child.parent == ids.pid, "left")
                 .select("node", F.when(F.col("pid").isNotNull(), F.col("parent"))
                                  .otherwise(F.col("node")).alias("ptr"))
                 .unionByName(nodes.filter("parent = ''").select("node", F.col("node").alias("ptr"))))
    base = cut_lineage(base.withColumn("done", F.col("ptr") == F.col("node")))
    p, cyclic = _double(base, max_rounds)
    if cyclic:
        cycle_nodes = p.filter(~F.col("done")).select(F.col("ptr").alias("node")).distinct()
        cut = (base.join(cycle_nodes.withColumn("on_cycle", F.lit(True)), "node", "left")
                   .select("node",
                           F.when(F.col("on_cycle"), F.col("node")).otherwise(F.col("ptr")).alias("ptr"))
                   .withColumn("done", F.col("ptr") == F.col("node")))
        p, cyclic = _double(cut_lineage(cut), max_rounds)
        if cyclic:
            raise RuntimeError("cycles left after cutting")
    return p.select(F.col("node").alias("tweet_id"), F.col("ptr").alias("root_id"))


# ------------------------------------------------------------------ B12 / B13

def thread_sizes(rooted: DataFrame) -> DataFrame:
    return rooted.groupBy("root_id").agg(F.count(F.lit(1)).alias("n_tweets"))


def describe_sizes(sizes: DataFrame, c: str = "n_tweets") -> DataFrame:
    """count, mean, std, min, quartiles, max; quartiles are exact but come
    from a size histogram, not from buffering every size in one task."""
    from ticketlake.operators.profile import exact_percentiles
    x = F.col(c).cast("double")
    q = exact_percentiles(sizes, c, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return sizes.agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max")).select(
        "count", "mean", "std", "min", *[q.select(n).scalar().alias(n) for n in ("p25", "p50", "p75")], "max")


def two_sided_roots(rooted_tweets: DataFrame, brand: str) -> DataFrame:
    """Roots whose thread has both a brand tweet and a non-brand tweet."""
    is_brand = F.col("author_id") == brand
    return (rooted_tweets.groupBy("root_id")
            .agg(F.bool_or(is_brand).alias("has_brand"), F.bool_or(~is_brand).alias("has_other"),
                 F.count(F.lit(1)).alias("n_tweets"))
            .filter(F.col("has_brand") & F.col("has_other"))
            .select("root_id", "n_tweets"))


# ------------------------------------------------------------------ B14-B19

def assemble_conversations(turns: DataFrame, brand_speaker: str = "Brand",
                           customer_speaker: str = "Customer", chunk_unit: str = "minute") -> DataFrame:
    """One row per conversation from a turn table (conversation_id, tweet_id
    BIGINT, is_brand, inbound, created_at, text): transcript, customer side,
    brand side and stats. Order: time (nulls last), then tweet id; null texts
    are skipped, empty ones are lines.

    Two-level aggregation so a hot conversation is never sorted or collected
    whole in one task: level 1 groups (conversation, time bucket of
    `chunk_unit`; rows without a time by runs of 1024 ids) and renders sorted
    partial texts plus partial stats; level 2 concatenates the bucket parts in
    bucket order (one element per bucket). Buckets are contiguous in the sort order, so the result equals a
    single global sort per conversation."""
    chunk = F.date_trunc(chunk_unit, F.col("created_at"))
    t = F.array_sort(F.collect_list(F.struct(
        F.col("created_at").isNull().alias("ts_null"), F.col("created_at").alias("ts"),
        F.col("tweet_id").alias("id"), F.col("is_brand").alias("b"), F.col("text").alias("x"))))
    run = F.when(F.col("created_at").isNull(), F.shiftright(F.col("tweet_id"), 10)).otherwise(0)
    lvl1 = turns.groupBy("conversation_id", chunk.alias("chunk"), run.alias("run")).agg(
        t.alias("t"),
        F.count("tweet_id").alias("n"),
        F.count_if(F.col("inbound")).cast("long").alias("n_in"),
        F.min("created_at").alias("mn"),
        F.max("created_at").alias("mx"))
    with_text = F.filter("t", lambda e: e["x"].isNotNull())
    speaker = lambda e: F.when(e["b"], F.lit(brand_speaker)).otherwise(F.lit(customer_speaker))
    # a bucket without lines is null, which the join of the buckets leaves out
    lines = lambda a: F.when(F.size(a) > 0, F.array_join(a, "\n"))
    parts = lvl1.select(
        "conversation_id", "chunk", "run", "n", "n_in", "mn", "mx",
        lines(F.transform(with_text, lambda e: F.concat(speaker(e), F.lit(": "), e["x"]))).alias("pc"),
        lines(F.transform(F.filter(with_text, lambda e: ~e["b"]), lambda e: e["x"])).alias("pu"),
        lines(F.transform(F.filter(with_text, lambda e: e["b"]), lambda e: e["x"])).alias("pb"))
    g = parts.groupBy("conversation_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("chunk").isNull().alias("cn"), "chunk", "run", "pc", "pu", "pb")))
         .alias("p"),
        F.sum("n").alias("turn_count"), F.sum("n_in").alias("customer_turns"),
        F.min("mn").alias("first_timestamp"), F.max("mx").alias("last_timestamp"))

    def joined(field: str) -> Column:
        return F.array_join(F.transform("p", lambda e: e[field]), "\n")

    return g.select("conversation_id", joined("pc").alias("conversation"), joined("pu").alias("customer_problem"),
                    joined("pb").alias("brand_responses"), F.col("turn_count").cast("long").alias("turn_count"),
                    F.col("customer_turns").cast("long").alias("customer_turns"), "first_timestamp", "last_timestamp")


def clean_conversations(conv: DataFrame, min_turns: int = 2) -> DataFrame:
    """Null -> '' and whitespace strip on both sides; keep rows with both
    sides non-empty and at least `min_turns` turns."""
    c = conv.withColumns({
        "customer_problem": strip_ws(F.coalesce("customer_problem", F.lit(""))),
        "brand_responses": strip_ws(F.coalesce("brand_responses", F.lit(""))),
    })
    return c.filter((F.col("customer_problem") != "") & (F.col("brand_responses") != "")
                    & (F.col("turn_count") >= min_turns))
