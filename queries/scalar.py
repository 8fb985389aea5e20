"""Bits, arrays, strings and rules."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from queries.base import CANONICAL_SQL, COMPOUNDS_SQL, TANIMOTO_SQL, compounds, query, table
from queries.joins import LEAD_SQL, _with_leader
from tamis.functions import bits, rows, text
from tamis.operators import rules
from tamis.session import spread

N_BITS = 64


@query(
    "bits_to_vector",
    f"""WITH {COMPOUNDS_SQL} SELECT id, CAST(i - 1 AS INTEGER) AS position, CAST(substr(bits, CAST(i AS INTEGER), 1) AS DOUBLE) AS value
        FROM compounds, range(1, 65) t(i)""",
)
def bits_to_vector(spark, sf):
    values = vector_to_array(bits.bits_to_vector("bits"))
    return compounds(spark, sf).select("id", F.posexplode(values).alias("position", "value"))


@query("bits_pack", f"WITH {COMPOUNDS_SQL} SELECT id, CAST(CAST(bits AS BIT) AS BIGINT) AS word FROM compounds")
def bits_pack(spark, sf):
    return compounds(spark, sf).select("id", bits.pack_bits("bits", N_BITS)[0].alias("word"))


PAIRS_SQL = f"{COMPOUNDS_SQL}, lead AS ({LEAD_SQL}), pair AS (SELECT a.id, {TANIMOTO_SQL} AS sim FROM compounds a JOIN lead l ON a.id = l.id JOIN compounds b ON b.id = l.leader)"


def _pairs(spark, sf):
    df = _with_leader(spark, sf)
    heads = compounds(spark, sf).select(F.col("id").alias("leader"), F.col("fp").alias("head"))
    return df.join(heads, "leader")


@query("tanimoto", f"WITH {PAIRS_SQL} SELECT id, round(sim, 9) AS similarity FROM pair")
def tanimoto(spark, sf):
    return _pairs(spark, sf).select("id", F.round(bits.tanimoto("fp", "head", 1), 9).alias("similarity"))


@query("jaccard_distance", f"WITH {PAIRS_SQL} SELECT id, round(1 - sim, 9) AS distance FROM pair")
def jaccard_distance(spark, sf):
    return _pairs(spark, sf).select("id", F.round(bits.jaccard("fp", "head", 1), 9).alias("distance"))


@query(
    "bit_recode",
    f"""WITH {COMPOUNDS_SQL}, b AS (SELECT id, i - 1 AS position, substr(bits, CAST(i AS INTEGER), 1) = '1' AS one
          FROM compounds, range(1, 65) t(i)),
        m AS (SELECT position, count(*) FILTER (WHERE one) * 1e0 / count(*) AS share FROM b GROUP BY position)
        SELECT id, CAST(b.position AS INTEGER) AS position, round(CASE WHEN one THEN share ELSE share - 1 END, 9) AS value
        FROM b JOIN m ON b.position = m.position""",
)
def bit_recode(spark, sf):
    df = compounds(spark, sf)
    learned = (
        df.select(F.posexplode(bits.bits_to_array("bits")).alias("position", "bit"))
        .groupBy("position")
        .agg((F.count_if(F.col("bit") == 1) / F.count("*")).alias("one"))
        .withColumn("zero", F.col("one") - 1)
    )
    out = bits.recode_bits(df, "bits", learned)
    return out.select("id", F.posexplode("recoded").alias("position", "value")).withColumn("value", F.round("value", 9))


CHARS = {**{chr(ord("a") + i): i + 1 for i in range(26)}, " ": 27}
CODES_SQL = "list_transform(string_split(p_name, ''), lambda c: CASE WHEN c = ' ' THEN 27 ELSE ascii(c) - 96 END)"


@query("char_encode", f"SELECT p_partkey, array_to_string({CODES_SQL}, ',') AS codes FROM part")
def char_encode(spark, sf):
    codes = text.encode_chars("p_name", CHARS)
    return table(spark, sf, "part").select("p_partkey", F.array_join(codes, ",").alias("codes"))


def _padded(n: int) -> str:
    return f"list_concat(list_transform(range({n} - len(c)), lambda z: 0), c[greatest(1, len(c) - {n - 1}):])"


@query(
    "pad_sequence",
    f"""SELECT p_partkey, array_to_string({_padded(16)}, ',') AS wide, array_to_string({_padded(9)}, ',') AS narrow
        FROM (SELECT p_partkey, {CODES_SQL} AS c FROM part)""",
)
def pad_sequence(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", text.encode_chars("p_name", CHARS).alias("c"))
    return df.select(
        "p_partkey",
        F.array_join(text.pad_left("c", 16), ",").alias("wide"),
        F.array_join(text.pad_left("c", 9), ",").alias("narrow"),
    )


@query(
    "tensor_flatten",
    """SELECT vec_id, CAST(j AS INTEGER) AS position,
         round(CAST(embedding[CAST((j % 3) * 16 + ((j // 3) % 4) * 4 + j // 12 + 1 AS INTEGER)] AS DOUBLE), 6) AS value,
         CASE WHEN j < 12 THEN round(list_sum(list_transform(range(4), lambda s:
           CAST(embedding[CAST((j % 3) * 16 + (j // 3) * 4 + s + 1 AS INTEGER)] AS DOUBLE))), 6) END AS summed
       FROM embeddings, range(48) t(j)""",
)
def tensor_flatten(spark, sf):
    cell = lambda g, p: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda s: F.get("e", g * 16 + p * 4 + s - 1))
    axis = F.sequence(F.lit(0), F.lit(3))
    df = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    tensor = F.transform(axis, lambda g: F.transform(axis, lambda p: cell(g, p)))
    df = df.select("vec_id", tensor.alias("t"))
    both = F.arrays_zip(
        rows.flatten_tensor("t", 3).alias("value"), rows.flatten_tensor("t", 3, sum_segments=True).alias("summed")
    )
    out = df.select("vec_id", F.posexplode(both).alias("position", "v"))
    return out.select("vec_id", "position", F.round("v.value", 6).alias("value"), F.round("v.summed", 6).alias("summed"))


@query(
    "stack_labels",
    """SELECT doc_id, CAST(0 AS INTEGER) AS position, CAST(quality AS DOUBLE) AS value FROM labels
       UNION ALL SELECT doc_id, 1, CAST(toxic AS DOUBLE) FROM labels""",
)
def stack_labels(spark, sf):
    stacked = rows.stack_labels(["quality", "toxic"])
    return table(spark, sf, "labels").select("doc_id", F.posexplode(stacked).alias("position", "value"))


# A small alert catalog.
RULES = [
    (1, "A", "[0-9]{3,}", 0, "digits"),
    (2, "A", "@", 0, "at sign"),
    (3, "B", "(?i)license", 1, "license"),
    (4, "C", "the", 5, "articles"),
]
SWITCHES = '{"MW": [0, 500], "Rule_A": true, "Rule_B": true, "Rule_C": false}'


def _rules(spark):
    return spark.createDataFrame(RULES, "rule_id int, rule_set_name string, pattern string, max int, description string")


def _alert_sql(kept) -> str:
    cases = " ".join(
        f"WHEN len(regexp_extract_all(text, '{p}')) > {m} THEN '{d} > {m}'" for _, s, p, m, d in RULES if s in kept
    )
    return f"CASE WHEN text IS NULL THEN 'INVALID' {cases} ELSE 'OK' END"


@query("alert_rules", f"SELECT doc_id, {_alert_sql('ABC')} AS alert FROM documents")
def alert_rules(spark, sf):
    return rules.apply_rules(spread(table(spark, sf, "documents"), "doc_id"), "text", _rules(spark)).select("doc_id", "alert")


@query(
    "rule_set_select",
    f"SELECT alert, count(*) AS n FROM (SELECT {_alert_sql('AB')} AS alert FROM documents) GROUP BY alert",
)
def rule_set_select(spark, sf):
    enabled = rules.enabled_rules(_rules(spark), SWITCHES)
    marked = rules.apply_rules(spread(table(spark, sf, "documents"), "doc_id"), "text", enabled)
    return marked.groupBy("alert").agg(F.count("*").alias("n"))


PATTERNS = ["[0-9]{3,}", "@", "(?i)license"]


@query(
    "any_pattern_flag",
    f"""SELECT lang, quality, count(*) AS n, CAST(sum(f) AS BIGINT) AS n_flagged FROM (
          SELECT d.lang, l.quality, CAST({' OR '.join(f"regexp_matches(text, '{p}')" for p in PATTERNS)} AS INTEGER) AS f
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY lang, quality""",
)
def any_pattern_flag(spark, sf):
    flags = table(spark, sf, "documents").select("doc_id", "lang", rules.any_match("text", PATTERNS).alias("f"))
    return (
        flags.join(table(spark, sf, "labels"), "doc_id", "left")
        .groupBy("lang", "quality")
        .agg(F.count("*").alias("n"), F.sum("f").alias("n_flagged"))
    )


SALTS = ["red", "small", "ECONOMY", "PROMO"]


@query(
    "strip_components",
    f"""SELECT p_partkey, array_to_string(list_filter(list_append(string_split(p_name, ' '), p_type),
          lambda w: w NOT IN ({', '.join(f"'{s}'" for s in SALTS)})), '.') AS stripped FROM part""",
)
def strip_components(spark, sf):
    whole = F.concat_ws(".", F.array_append(F.split("p_name", " "), F.col("p_type")))
    return table(spark, sf, "part").select("p_partkey", text.strip_parts(whole, SALTS).alias("stripped"))


def hash_fp_sql(n_bits: int, radius: int) -> str:
    """Ones of the hashed fingerprint of each document: rows doc_id, bit of table ones."""
    run = lambda k: " || ' ' || ".join(["a", *[f"lead(a, {j}) OVER w" for j in range(1, k)]])
    runs = " UNION ALL ".join(
        f"SELECT doc_id, {run(k)} AS s FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY i)"
        for k in range(1, radius + 2)
    )
    return f"""words AS (SELECT doc_id, string_split({CANONICAL_SQL}, ' ') AS w FROM documents),
          tokens AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS i FROM words),
          runs AS ({runs}),
          ones AS (SELECT DISTINCT doc_id, CAST(CAST('0x' || substr(md5(s), 1, 8) AS BIGINT) % {n_bits} AS INTEGER) AS bit
                   FROM (SELECT DISTINCT doc_id, s FROM runs WHERE s IS NOT NULL))"""


@query(
    "hashed_fingerprint",
    f"""WITH {hash_fp_sql(1024, 2)}
        SELECT doc_id, count(*) AS n_ones, md5(string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit)) AS digest FROM ones GROUP BY doc_id""",
)
def hashed_fingerprint(spark, sf):
    words = F.split(text.canonical("text"), " ")
    docs = spread(table(spark, sf, "documents"), "doc_id")
    df = docs.select("doc_id", text.hash_fp(words, 2, 1024).alias("f"))
    return df.select("doc_id", F.size("f").cast("long").alias("n_ones"), F.md5(F.array_join("f", ",")).alias("digest"))


@query("canonical_key", f"SELECT doc_id, md5({CANONICAL_SQL}) AS key FROM documents")
def canonical_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.canonical("text")).alias("key"))
