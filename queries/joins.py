"""Joins."""

from pyspark.sql import functions as F

from queries.base import (
    COMPOUNDS_SQL, FOLDED_SQL, N_BITS, SCORES_SQL, TANIMOTO_SQL, TEXTS_SQL,
    compounds, query, table, texts, two_scores,
)
from tamis.operators import joins, neighbors
from tamis.operators.identity import group_identities
from tamis.operators.splits import stratified_folds


@query(
    "inner_join_suffix",
    """SELECT p_partkey AS partkey, p_name AS name, p_retailprice AS price, l_extendedprice AS price_y, l_orderkey
       FROM part JOIN lineitem ON p_partkey = l_partkey""",
)
def inner_join_suffix(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("partkey"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")
    )
    lines = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("partkey"), F.col("l_extendedprice").alias("price"), "l_orderkey"
    )
    return joins.join_suffix(part, lines, "partkey", "partkey")


@query(
    "enrich_join",
    """SELECT o_orderkey, o_custkey, c_mktsegment, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def enrich_join(spark, sf):
    info = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return joins.enrich(orders, info, "o_custkey", ["c_mktsegment", "c_nationkey"])


def _known_and_new(spark, sf):
    docs = texts(spark, sf)
    ids = table(spark, sf, "labels").select("doc_id")
    return docs.join(ids, "doc_id", "left_semi"), docs.join(ids, "doc_id", "left_anti")


@query(
    "anti_known",
    f"""WITH {TEXTS_SQL} SELECT doc_id, n_chars FROM texts
        WHERE NOT labelled AND canonical NOT IN (SELECT canonical FROM texts WHERE labelled)""",
)
def anti_known(spark, sf):
    known, new = _known_and_new(spark, sf)
    kept, _ = joins.exclude_known(new, known, key="canonical")
    return kept.select("doc_id", "n_chars")


@query(
    "anti_known_report",
    f"""WITH {TEXTS_SQL} SELECT count(*) AS n_rows, count(*) - count(*) FILTER (WHERE seen) AS n_kept,
          CAST(0 AS BIGINT) AS n_without_key, count(*) FILTER (WHERE seen) AS n_removed
        FROM (SELECT canonical IN (SELECT canonical FROM texts WHERE labelled) AS seen FROM texts WHERE NOT labelled)""",
)
def anti_known_report(spark, sf):
    known, new = _known_and_new(spark, sf)
    return joins.exclusion_report(new, known, key="canonical")


@query(
    "anti_shared",
    f"""WITH {TEXTS_SQL} SELECT doc_id FROM texts WHERE lang = 'en'
        AND canonical NOT IN (SELECT t.canonical FROM texts t WHERE t.source IN ('src1', 'src2', 'src3'))""",
)
def anti_shared(spark, sf):
    docs = texts(spark, sf)
    other = docs.filter(F.col("source").isin("src1", "src2", "src3"))
    return joins.exclude_shared(docs.filter("lang = 'en'"), other, "canonical").select("doc_id")


LEAD_SQL = "SELECT vec_id AS id, label AS cluster, min(vec_id) OVER (PARTITION BY label) AS leader FROM embeddings"


def _with_leader(spark, sf):
    df = compounds(spark, sf)
    first = df.groupBy("cluster").agg(F.min("id").alias("leader"))
    return df.join(first, "cluster")


@query("semi_leaders", f"WITH c AS ({LEAD_SQL}) SELECT id, cluster FROM c WHERE id IN (SELECT leader FROM c)")
def semi_leaders(spark, sf):
    return joins.leaders(_with_leader(spark, sf), "id", "leader").select("id", "cluster")


RECONCILED_SQL = """found AS (
  SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS a,
         o_custkey IN (SELECT l_partkey FROM lineitem) AS b FROM orders)"""


def _reconciled(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return joins.reconcile(orders, lines, ("o_orderkey", "l_orderkey"), ("o_custkey", "l_partkey"), "o_orderkey")


@query(
    "key_reconcile",
    f"""WITH {RECONCILED_SQL} SELECT o_orderkey, CASE WHEN a THEN 'a' ELSE 'b' END AS found_by
        FROM found WHERE a <> b""",
)
def key_reconcile(spark, sf):
    return joins.only_one_way(_reconciled(spark, sf))


@query(
    "positional_join",
    f"""WITH {SCORES_SQL} SELECT row_number() OVER (ORDER BY id) AS position, id AS id_a, score_a, id AS id_b, score_b,
          CAST(1 AS INTEGER) AS aligned FROM two_scores""",
)
def positional_join(spark, sf):
    scores = two_scores(spark, sf)
    a = scores.select(F.col("id").alias("id_a"), "score_a")
    b = scores.select(F.col("id").alias("id_b"), "score_b")
    return joins.zip_rows(a, b, ["id_a"], ["id_b"], ("id_a", "id_b"))


SETS_SQL = """CASE WHEN substr(md5(CAST(id AS VARCHAR)), 1, 1) < '8' THEN 'train'
                  WHEN substr(md5(CAST(id AS VARCHAR)), 1, 1) < 'c' THEN 'ordered' ELSE 'real' END"""


def clustered(spark, sf):
    """Compounds with a data set and a fine cluster, the first six bits."""
    first = F.substring(F.md5(F.col("id").cast("string")), 1, 1)
    return compounds(spark, sf).select(
        "id",
        F.substring("bits", 1, 6).alias("cluster"),
        F.col("active").alias("hit"),
        F.when(first < "8", "train").when(first < "c", "ordered").otherwise("real").alias("dataset"),
    )


CLUSTERED_SQL = (
    COMPOUNDS_SQL
    + f", clustered AS (SELECT id, substr(bits, 1, 6) AS cluster, active AS hit, {SETS_SQL} AS dataset FROM compounds)"
)


def _flag_sql(name: str) -> str:
    return f"""CAST(coalesce(bool_or(c.dataset = '{name}'), false) AS INTEGER) AS in_{name},
      CAST(coalesce(sum(c.hit) FILTER (WHERE c.dataset = '{name}'), 0) > 0 AS INTEGER) AS active_in_{name}"""


@query(
    "cluster_flags",
    f"""WITH {CLUSTERED_SQL}, known AS (SELECT * FROM clustered WHERE dataset <> 'real')
        SELECT r.id, r.cluster, {_flag_sql('train')}, {_flag_sql('ordered')}
        FROM clustered r LEFT JOIN known c ON r.cluster = c.cluster WHERE r.dataset = 'real' GROUP BY r.id, r.cluster""",
)
def cluster_flags(spark, sf):
    rows = clustered(spark, sf)
    candidates = rows.filter("dataset = 'real'").select("id", "cluster")
    return joins.cluster_flags(
        candidates, rows.filter("dataset <> 'real'"), "cluster", "dataset", "hit", ["train", "ordered"]
    )


def _refs(df, condition: str):
    return df.filter(condition).select(F.col("id").alias("ref_id"), F.col("fp").alias("ref_fp"))


@query(
    "nearest_active",
    f"""WITH {COMPOUNDS_SQL}, s AS (SELECT a.id, b.id AS ref, {TANIMOTO_SQL} AS sim
          FROM compounds a, compounds b WHERE b.active = 1)
        SELECT id, arg_min(ref, (-sim, ref)) AS nearest_id, round(max(sim), 6) AS similarity FROM s GROUP BY id""",
)
def nearest_active(spark, sf):
    df = compounds(spark, sf)
    near = neighbors.nearest(df.select("id", "fp"), _refs(df, "active = 1"), "fp", "id", N_BITS)
    return near.select("id", "nearest_id", F.round("nearest_similarity", 6).alias("similarity"))


@query(
    "nearest_by_group",
    f"""WITH {COMPOUNDS_SQL}, s AS (SELECT a.id, b.id AS ref, b.cluster, {TANIMOTO_SQL} AS sim
          FROM compounds a, compounds b WHERE a.cluster NOT IN (1, 2) AND b.cluster IN (1, 2))
        SELECT id, arg_min(ref, (-sim, ref)) FILTER (WHERE cluster = 1) AS nearest_train_id,
               round(1 - max(sim) FILTER (WHERE cluster = 1), 6) AS distance_train,
               arg_min(ref, (-sim, ref)) FILTER (WHERE cluster = 2) AS nearest_ordered_id,
               round(1 - max(sim) FILTER (WHERE cluster = 2), 6) AS distance_ordered
        FROM s GROUP BY id""",
)
def nearest_by_group(spark, sf):
    df = compounds(spark, sf)
    refs = df.filter("cluster IN (1, 2)").select(
        F.col("id").alias("ref_id"),
        F.col("fp").alias("ref_fp"),
        F.when(F.col("cluster") == 1, "train").otherwise("ordered").alias("dataset"),
    )
    rows = df.filter("cluster NOT IN (1, 2)").select("id", "fp")
    near = neighbors.nearest_per_group(rows, refs, ["train", "ordered"], "dataset", "fp", "id", N_BITS)
    return near.select(
        "id",
        "nearest_train_id",
        F.round("distance_train", 6).alias("distance_train"),
        "nearest_ordered_id",
        F.round("distance_ordered", 6).alias("distance_ordered"),
    )


@query(
    "nearest_leader",
    f"""WITH {COMPOUNDS_SQL}, leaders AS (SELECT * FROM compounds WHERE id IN (SELECT min(id) FROM compounds GROUP BY cluster)),
          s AS (SELECT a.id, b.id AS ref, b.cluster, {TANIMOTO_SQL} AS sim FROM compounds a, leaders b)
        SELECT id, arg_min(ref, (-sim, ref)) AS leader_id, arg_min(cluster, (-sim, ref)) AS cluster FROM s GROUP BY id""",
)
def nearest_leader(spark, sf):
    df = _with_leader(spark, sf)
    leaders = joins.leaders(df, "id", "leader").select(
        F.col("id").alias("head_id"), F.col("fp").alias("head_fp"), "cluster"
    )
    near = neighbors.assign_leader(
        df.select("id", "fp"), leaders.withColumnRenamed("head_id", "lid"), "fp", "id", N_BITS, "lid", "head_fp", ["cluster"]
    )
    return near.select("id", "leader_id", "cluster")


DISTANCE = 0.5


@query(
    "pairwise_distance",
    f"""WITH {COMPOUNDS_SQL}, d AS (SELECT bits, min(id) AS id, count(*) AS n FROM compounds GROUP BY bits),
          s AS (SELECT a.id AS id_a, b.id AS id_b, 1 - {TANIMOTO_SQL} AS distance, a.n AS copies_a, b.n AS copies_b
                FROM d a JOIN d b ON a.id < b.id)
        SELECT id_a, id_b, round(distance, 6) AS distance, copies_a, copies_b FROM s WHERE distance <= {DISTANCE} + 1e-9""",
)
def pairwise_distance(spark, sf):
    df = compounds(spark, sf).select("id", "fp")
    pairs = neighbors.pairwise(df, None, "fp", "id", N_BITS, DISTANCE)
    return pairs.withColumn("distance", F.round("distance", 6))


@query(
    "pairwise_increment",
    f"""WITH {COMPOUNDS_SQL}, x AS (SELECT bits, min(id) AS id, count(*) AS n FROM compounds WHERE cluster < 5 GROUP BY bits),
          y AS (SELECT bits, min(id) AS id, count(*) AS n FROM compounds WHERE cluster >= 5 GROUP BY bits),
          s AS (SELECT a.id AS id_a, b.id AS id_b, 1 - {TANIMOTO_SQL} AS distance, a.n AS copies_a, b.n AS copies_b FROM x a, y b
                UNION ALL
                SELECT a.id, b.id, 1 - {TANIMOTO_SQL}, a.n, b.n FROM y a JOIN y b ON a.id < b.id)
        SELECT id_a, id_b, round(distance, 6) AS distance, copies_a, copies_b FROM s WHERE distance <= {DISTANCE} + 1e-9""",
)
def pairwise_increment(spark, sf):
    df = compounds(spark, sf)
    old, new = df.filter("cluster < 5").select("id", "fp"), df.filter("cluster >= 5").select("id", "fp")
    pairs = neighbors.extend_pairs(old, new, "fp", "id", N_BITS, DISTANCE)
    return pairs.withColumn("distance", F.round("distance", 6))


@query("attach_fold", f"WITH {FOLDED_SQL} SELECT id, cluster, fold_id FROM folded")
def attach_fold(spark, sf):
    df = compounds(spark, sf)
    folds = stratified_folds(df.select("id", "active"), "id", "active")
    return joins.attach_fold(df.select("id", "cluster"), folds, "id")


@query(
    "mapping_check",
    """WITH b AS (SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN upper(r_name) || '-' || n_name ELSE n_name END AS n_name
                  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'
                  UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1),
          m AS (SELECT n_nationkey, count(*) AS n_matches, min(n_name) AS other FROM b GROUP BY n_nationkey)
       SELECT a.n_nationkey, a.n_name, m.other, coalesce(m.n_matches, 0) AS n_matches
       FROM nation a LEFT JOIN m ON a.n_nationkey = m.n_nationkey
       WHERE NOT (coalesce(m.n_matches, 0) = 1 AND a.n_name = m.other)""",
)
def mapping_check(spark, sf):
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    renamed = F.concat(F.upper("r_name"), F.lit("-"), F.col("n_name"))
    changed = nation.join(region.filter("r_name <> 'ASIA'"), "n_regionkey").select(
        "n_nationkey", F.when(F.col("n_regionkey") == 0, renamed).otherwise(F.col("n_name")).alias("n_name")
    )
    twice = nation.filter("n_regionkey = 1").select("n_nationkey", "n_name")
    return joins.compare_maps(nation.select("n_nationkey", "n_name"), changed.union(twice), "n_nationkey", "n_name")


@query(
    "unmatched_append",
    """SELECT o_custkey AS custkey, count(*) AS n_orders, NULL AS name FROM orders GROUP BY o_custkey
       UNION ALL SELECT c_custkey, NULL, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def unmatched_append(spark, sf):
    per = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n_orders"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"))
    return joins.append_unmatched(per, customers, "custkey", per)


ROW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


@query(
    "identity_groups",
    f"""WITH RECURSIVE k AS (SELECT *, concat_ws('-', l_partkey, l_suppkey, l_linenumber) AS structure FROM lineitem),
          e AS (SELECT DISTINCT a.l_orderkey AS u, b.l_orderkey AS v FROM k a JOIN k b
                ON a.structure = b.structure AND a.l_orderkey <> b.l_orderkey),
          r(u, m) AS (SELECT u, u FROM e UNION SELECT e.v, r.m FROM r JOIN e ON e.u = r.u WHERE r.m < e.v),
          c AS (SELECT u, min(m) AS m FROM r GROUP BY u)
        SELECT k.l_orderkey, k.l_linenumber, structure, coalesce(c.m, k.l_orderkey) AS molecule_id,
               row_number() OVER (PARTITION BY coalesce(c.m, k.l_orderkey) ORDER BY {', '.join('k.' + c for c in ROW_ORDER)}) - 1
                 AS duplicate_id
        FROM k LEFT JOIN c ON c.u = k.l_orderkey""",
)
def identity_groups(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn(
        "structure", F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber")
    )
    found = group_identities(rows, "l_orderkey", "structure", ROW_ORDER)
    return found.select("l_orderkey", "l_linenumber", "structure", "molecule_id", "duplicate_id")
