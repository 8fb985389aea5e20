"""Raw readings to training rows, end to end."""

from pyspark.sql import functions as F

from queries.base import query, table
from tamis.functions.bits import ones
from tamis.plans.prepare import master_table, training_table

UNIQUE = ["sample_id", "plate_name", "plate_well", "run_date", "inhibition"]
N_BITS, RADIUS = 1024, 2

PREPARED_SQL = f"""raw AS (
    SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, concat('P', l_partkey, '  s', l_suppkey, ' L', l_linenumber, '.', l_returnflag) AS structure,
           concat('part ', l_suppkey % 7) AS library_id, CASE WHEN l_returnflag = 'R' THEN 'CP1' ELSE 'P1' END AS plate_name,
           concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS plate_well, strftime(l_shipdate, '%Y-%m-%d') AS run_date,
           CASE WHEN l_tax = 0 THEN -100e0 ELSE l_quantity * 2e0 END AS inhibition
    FROM lineitem),
  rows AS (SELECT *, CAST(contains(plate_name, 'CP') AS INTEGER) AS is_retest,
                  regexp_replace(lower(regexp_replace(structure, '[.]N$', '')), ' +', ' ', 'g') AS canonical FROM raw WHERE inhibition > -100),
  e AS (SELECT DISTINCT a.sample_id AS u, b.sample_id AS v FROM rows a JOIN rows b ON a.canonical = b.canonical AND a.sample_id <> b.sample_id),
  r(u, m) AS (SELECT u, u FROM e UNION SELECT e.v, r.m FROM r JOIN e ON e.u = r.u WHERE r.m < e.v),
  c AS (SELECT u, min(m) AS m FROM r GROUP BY u),
  named AS (SELECT rows.*, coalesce(c.m, sample_id) AS molecule_id FROM rows LEFT JOIN c ON c.u = sample_id),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY molecule_id ORDER BY {', '.join(UNIQUE)}) AS n FROM named),
  filters AS (SELECT molecule_id, CAST(coalesce(median(inhibition) FILTER (WHERE is_retest = 0) >= 35, false) AS INTEGER) AS primary_filter,
                CAST(coalesce(median(inhibition) FILTER (WHERE is_retest = 1) >= 35, false) AS INTEGER) AS retest_filter,
                1 - max(CAST(contains(canonical, ' l7') AS INTEGER)) AS alert_filter FROM named GROUP BY molecule_id),
  molecules AS (SELECT molecule_id, arg_min(canonical, n) AS canonical, median(inhibition) AS median,
                  array_to_string(list_sort(list(DISTINCT sample_id)), ', ') AS sample_ids,
                  array_to_string(list_sort(list(DISTINCT library_id)), ', ') AS library_ids FROM numbered WHERE is_retest = 0 GROUP BY molecule_id),
  words AS (SELECT *, primary_filter * retest_filter * alert_filter AS activity, string_split(canonical, ' ') AS w
            FROM molecules JOIN filters USING (molecule_id)),
  runs AS (SELECT *, flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))) AS s FROM words),
  prints AS (SELECT *, list_sort(list_distinct(list_transform(s, lambda x: CAST(CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % {N_BITS} AS INTEGER)))) AS ones FROM runs)"""


def raw_readings(spark, sf):
    """Lines of orders in the schema of a raw screen."""
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("sample_id"),
        F.concat(F.lit("P"), "l_partkey", F.lit("  s"), "l_suppkey", F.lit(" L"), "l_linenumber", F.lit("."), flag).alias("structure"),
        F.col("l_linestatus").alias("batch_name"),
        F.concat(F.lit("part "), F.col("l_suppkey") % 7).alias("library_id"),
        F.when(flag == "R", "CP1").otherwise("P1").alias("plate_name"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("plate_well"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("run_date"),
        F.when(F.col("l_tax") == 0, -100.0).otherwise(F.col("l_quantity") * 2.0).alias("inhibition"),
    )


@query(
    "prepare_training",
    f"""WITH RECURSIVE {PREPARED_SQL}
        SELECT molecule_id, sample_ids, library_ids, canonical, round(median, 6) AS median, activity, primary_filter, retest_filter, alert_filter,
               CAST(ntile(10) OVER (PARTITION BY activity ORDER BY md5(molecule_id), molecule_id) - 1 AS INTEGER) AS fold_id,
               md5(array_to_string(ones, ',')) AS print_digest FROM prints""",
)
def prepare_training(spark, sf):
    """Raw readings to folded, fingerprinted molecules."""
    alert = F.col("canonical").contains(" l7").cast("int")
    master = master_table(raw_readings(spark, sf), alert, UNIQUE, salts=["N"], radius=RADIUS, n_bits=N_BITS)
    rows = training_table(master, radius=RADIUS, n_bits=N_BITS)
    return rows.select(
        "molecule_id",
        "sample_ids",
        "library_ids",
        "canonical",
        F.round("inhibition_primary_median", 6).alias("median"),
        "activity",
        "primary_filter",
        "retest_filter",
        "alert_filter",
        "fold_id",
        F.md5(F.array_join(ones("fp", N_BITS // 64), ",")).alias("print_digest"),
    )
