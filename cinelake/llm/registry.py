"""The registered queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm import byte_bpe, decontamination, hard_negatives, jaccard_join, language_id, line_dedup, nearest, secrets, superminhash, token_counts, toxicity, vector_codes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages"), least_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), folds=5)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted", "e_value", F.size("passages").alias("n_passages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encoded_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = toxicity.held_out("doc_id", 4, 2)
    found = language_id.identify(docs, language_id.fit(docs.filter(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label, positives=5, negatives=3, least_percent=50, most_percent=95)


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_token_counts, op2_warc, op3_secrets, op4_line_dedup, op5_toxicity, op6_jaccard_join, op7_byte_bpe, op8_decontamination, op9_language_id, op10_nearest,
        op11_vector_codes, op12_hard_negatives, op13_superminhash,
    )}


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = (
    "case when len(w) >= {k} then list_distinct(list_transform(generate_series(1, len(w) - {k} + 1), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) "
    "when len(w) > 0 then [array_to_string(w, ' ')] else [] end"
)

# documents with their shingle sets, and the smallest id that links reach; {k} is the width of a shingle
_COMPONENTS = """
with recursive w as (select doc_id, list_filter(regexp_split_to_array({lower}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
sets as (select doc_id, {shingles} as s from w), sized as (select doc_id, len(s) as n, list_sort(s) as s from sets),
classes as (select min(doc_id) as rep, n, s from sized where n > 0 group by n, s),
flat as (select rep, n, unnest(s) as g from classes),
shared as (select a.rep as a, b.rep as b, a.n as na, b.n as nb, count(*) as c from flat a join flat b on a.g = b.g and a.rep > b.rep and a.n * 100 >= b.n * 85 and b.n * 100 >= a.n * 85 group by 1, 2, 3, 4),
links as (select a, b from shared where 100 * c >= 85 * (na + nb - c)),
edges as (select a, b from links union select b, a from links),
reach(node, seen) as (select rep, rep from classes union select e.a, r.seen from reach r join edges e on e.b = r.node),
smallest as (select node, min(seen) as component from reach group by 1)
select z.doc_id, z.n as n_shingles, coalesce(m.component, z.doc_id) as component_id from sized z left join classes c on c.s = z.s and z.n > 0 left join smallest m on m.node = c.rep
"""


def _components_sql(k: int) -> str:
    return _COMPONENTS.format(lower=_LOWER.format("coalesce(text, '')"), shingles=_SHINGLES.format(k=k))


OP6_SQL = _components_sql(4)
OP13_SQL = f"select doc_id, n_shingles, component_id, doc_id = component_id as kept from ({_components_sql(3)})"

OP8_SQL = f"""
with d as (select doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents where doc_id is not null),
b as (select item_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark where item_id is not null),
bs as (select item_id, least(len(w), 5) as k, {_SHINGLES.format(k=5)} as s from b), widths as (select distinct k from bs where k > 0),
ds as (select doc_id, k, unnest(list_distinct(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' ')))) as g from d join widths on len(w) >= k),
bf as (select item_id, k, len(s) as n_item, unnest(s) as g from bs),
hits as (select doc_id, item_id, n_item, count(distinct g) as n_shared from ds join bf using (k, g) group by 1, 2, 3)
select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment from hits where 10 * n_shared >= 8 * n_item
"""

OP10_SQL = """
with v as (select vec_id, embedding::double[] as v from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_cosine_similarity(q.v, c.v) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s qualify rank <= 5
"""

_REAL = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"


def _codes_sql(rounds: int = 2) -> str:
    """Codebooks c0, c1, … and the codes found with each, a0, a1, …; integer means are floors."""
    width = "(len(v) // 16)"
    steps = [f"""with v as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v from embeddings where {_REAL}),
p as (select vec_id, label, part, v[part * {width} + 1:(part + 1) * {width}] as x from v, (select unnest(generate_series(0, 15)) as part)),
c0 as (select part, cast(row_number() over (partition by part order by vec_id) as bigint) - 1 as entry, x as c from p qualify entry < 64)"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} as (select vec_id, any_value(label) as label, part, min({{'d': d, 'entry': entry}}) as best, any_value(x) as x
  from (select p.*, entry, cast(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from p join c{r} using (part)) group by vec_id, part)""")
        if r < rounds:
            steps.append(f"""m{r + 1} as (select part, entry, nth, cast(sum(e) as bigint) as s, count(*) as n from (select part, best.entry as entry, unnest(x) as e, generate_subscripts(x, 1) as nth from a{r}) group by 1, 2, 3),
c{r + 1} as (select part, entry, coalesce(u.c, c{r}.c) as c from c{r} left join (select part, entry, list((s - ((s % n) + n) % n) // n order by nth) as c from m{r + 1} group by 1, 2) u using (part, entry))""")
    return ",\n".join(steps) + f""",
rows as (select vec_id, any_value(label) as label, string_agg(printf('%02x', best.entry), '' order by part) as code, cast(sum(best.d) as bigint) as error from a{rounds} group by 1),
digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as h from c{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from rows, digest"""


OP11_SQL = _codes_sql()

OP12_SQL = f"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and {_REAL}),
s as (select a.vec_id as anchor_id, c.vec_id as other, a.label = c.label as same, cast(list_dot_product(a.v, c.v) as bigint) as score from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, other) as int) as rank, other as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score qualify rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against plain versions, round trips or held-out rows."""
    return {"op6_jaccard_join": OP6_SQL, "op8_decontamination": OP8_SQL, "op10_nearest": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_superminhash": OP13_SQL}
