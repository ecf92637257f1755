"""Queries of dataset curation over documents, examples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.functions import hashing, stats, text
from karst.operators import dedup, ledger, quality, sampling
from karst.plans.catalog import Tables, query
from karst.sources.staging import stage

_S = text.SPACE
_W = f"{text.WORD}+"


def _norm(x: str) -> str:
    return f"lower(trim(regexp_replace(translate({x}, '{text.DASHES}', '{text.PLAIN}'), '{_S}+', ' ', 'g')))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _key(x: str) -> str:
    """What stands behind the last question line."""
    return f"list_extract(string_split({x}, 'Вопрос:' || chr(10)), -1)"


def _said(role: str) -> str:
    return f"list_extract([m.content for m in messages if m.role = '{role}'], 1)"


def user():
    return quality.content_of("user")


def assistant():
    return quality.content_of("assistant")


@query("scan_parquet_project", "SELECT doc_id, source, n_chars FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", "n_chars")


@query("scan_limit", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "n_chars").orderBy("doc_id").limit(100)


@query("schema_violations", f"""
WITH r AS (SELECT *, [m.role for m in messages] AS roles FROM examples)
SELECT line_no, CASE WHEN id IS NULL OR {_strip('id')} = '' THEN 'id' WHEN messages IS NULL THEN 'messages'
  WHEN roles IS DISTINCT FROM ['system', 'user', 'assistant'] THEN 'roles'
  ELSE 'content' END AS reason
FROM r WHERE id IS NULL OR {_strip('id')} = '' OR messages IS NULL OR roles IS DISTINCT FROM ['system', 'user', 'assistant']
  OR len([m for m in messages if m.content IS NULL OR {_strip('m.content')} = '']) > 0""")
def _(t: Tables) -> DataFrame:
    return t.examples.select("line_no", quality.schema_reason().alias("reason")).where("reason is not null")


@query("unique_id_check", "SELECT id, count(*) AS n FROM split_examples GROUP BY id HAVING count(*) > 1 OR id IS NULL OR trim(id) = ''")
def _(t: Tables) -> DataFrame:
    from karst.sources.readers import repeated_keys

    return repeated_keys(t.split_examples, "id")


@query("file_sha256")
def _(t: Tables) -> DataFrame:
    from karst.sources.readers import file_digests

    return file_digests(t.spark, [f"{t.folder}/region.parquet", f"{t.folder}/nation.parquet"])


@query("latest_per_version", """
SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY loaded_at DESC, doc_id DESC) AS r FROM documents) WHERE r = 1""")
def _(t: Tables) -> DataFrame:
    return ledger.latest(t.documents.select("source", "doc_id", "n_chars", "loaded_at"), "source", ["loaded_at", "doc_id"]).drop("loaded_at")


@query("filter_required_nonblank", f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND {_strip('text')} <> '' AND source IS NOT NULL AND {_strip('source')} <> ''")
def _(t: Tables) -> DataFrame:
    return t.documents.where(~text.is_blank(F.col("text")) & ~text.is_blank(F.col("source"))).select("doc_id")


@query("filter_length_bounds", f"""
SELECT line_no, length({_said('user')}) AS n_user, length({_said('assistant')}) AS n_assistant FROM examples
WHERE length({_said('user')}) BETWEEN 30 AND 4000 AND length({_said('assistant')}) >= 2""")
def _(t: Tables) -> DataFrame:
    sized = t.examples.select("line_no", F.length(user()).alias("n_user"), F.length(assistant()).alias("n_assistant"))
    return sized.where("n_user between 30 and 4000 and n_assistant >= 2")


@query("filter_quality_label", "SELECT item_no, id FROM benchmark WHERE source IS NOT NULL AND len(slices) >= 2")
def _(t: Tables) -> DataFrame:
    return t.benchmark.where(F.col("source").isNotNull() & F.coalesce(F.size("slices") >= 2, F.lit(False))).select("item_no", "id")


_REASON = f"""CASE WHEN text IS NULL OR {_strip('text')} = '' OR source IS NULL OR {_strip('source')} = '' THEN 'missing'
  WHEN length({_strip('text')}) < 40 OR length({_strip('text')}) > 20000 THEN 'length' WHEN lang IS NULL OR lang NOT IN ('ru', 'en') THEN 'quality' ELSE 'kept' END"""


@query("drop_reason_counts", f"SELECT {_REASON} AS reason, count(*) AS n FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    body = text.strip(F.col("text"))
    reason = quality.first_reason([
        ("missing", text.is_blank(F.col("text")) | text.is_blank(F.col("source"))), ("length", ~F.length(body).between(40, 20000)), ("quality", ~F.coalesce(F.col("lang").isin("ru", "en"), F.lit(False))),
    ])
    return quality.drop_counts(t.documents, reason)


@query("normalize_text")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


@query("normalize_text_composed", f"SELECT doc_id, sha256({_norm('text')}) AS digest FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", hashing.sha256(text.normalize_text(F.col("text"), False)).alias("digest"))


@query("normalize_group", f"SELECT line_no, {_norm('split_part(topic, chr(124), 1)')} AS grp FROM examples")
def _(t: Tables) -> DataFrame:
    return t.examples.select("line_no", text.normalize_group(F.col("topic"), False).alias("grp"))


@query("question_key", f"SELECT line_no, {_norm(_key(_said('user')))} AS question FROM examples")
def _(t: Tables) -> DataFrame:
    return t.examples.select("line_no", text.question_key(user(), False).alias("question"))


@query("word_tokens", f"SELECT doc_id, len(regexp_extract_all(text, '{_W}')) AS n_words, list_extract(regexp_extract_all(text, '{_W}'), -1) AS last_word FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.words(F.col("text")).alias("w")).select("doc_id", F.when(F.col("w").isNotNull(), F.size("w")).alias("n_words"), F.try_element_at("w", F.lit(-1)).alias("last_word"))


@query("shingles", f"""
WITH w AS (SELECT line_no, regexp_extract_all({_norm(_key(_said('user')))}, '{_W}') AS w FROM examples),
s AS (SELECT line_no, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] END) AS s FROM w)
SELECT line_no, count(DISTINCT s) AS n_shingles, min(s) AS first_shingle FROM s GROUP BY line_no""")
def _(t: Tables) -> DataFrame:
    tokens = stage(t.examples.select("line_no", text.words(text.question_key(user(), False)).alias("w")), "words")
    each = tokens.select("line_no", F.explode(F.array_distinct(text.ngrams(F.col("w"), 4))).alias("s"))
    return each.groupBy("line_no").agg(F.count("*").alias("n_shingles"), F.min("s").alias("first_shingle"))


@query("sha256_key", "SELECT doc_id, sha256(text) AS digest, 'wiki_' || substr(sha256(text), 1, 24) AS id FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", hashing.sha256(F.col("text")).alias("digest")).withColumn("id", F.concat(F.lit("wiki_"), F.substr("digest", F.lit(1), F.lit(24))))


@query("hash_mod_bucket", """
SELECT doc_id, list_reduce(list_prepend(0, [strpos('0123456789abcdef', c) - 1 for c in string_split(sha256(doc_id::VARCHAR), '')]), lambda a, d: (a * 16 + d) % 5)::INT AS bucket FROM documents""")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", hashing.hex_mod(hashing.sha256(F.col("doc_id").cast("string")), 5).alias("bucket"))


@query("exact_duplicates", "SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents) WHERE doc_id > first")
def _(t: Tables) -> DataFrame:
    return dedup.later_copies(t.documents.select("doc_id", "text"), F.col("text"), "doc_id").select("doc_id", "first")


_HASH_KEY = f"sha256(coalesce(source, '') || chr(1) || {_norm('coalesce(text, chr(1))')})"


@query("dedup_by_hash_key", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_HASH_KEY}")
def _(t: Tables) -> DataFrame:
    key = F.concat(F.coalesce("source", F.lit("")), F.lit("\x01"), text.normalize_text(F.coalesce("text", F.lit("\x01")), False))
    return dedup.first_of(t.documents.select("doc_id", "source", "text"), key, "doc_id").select("doc_id")


@query("dedup_anti_join", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r > 1)")
def _(t: Tables) -> DataFrame:
    drops = dedup.later_copies(t.documents.select("doc_id", "text"), F.col("text"), "doc_id").select("doc_id")
    return t.documents.select("doc_id", "n_chars").join(drops, "doc_id", "left_anti")


@query("duplicate_share", "SELECT round(sum(c - 1) / sum(c), 6) AS share FROM (SELECT count(*) AS c FROM documents GROUP BY sha256(text))")
def _(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256)).count().agg(F.round(F.try_divide(F.sum(F.col("count") - 1), F.sum("count")), 6).alias("share"))


_FLOOR = "list_sort(list(n_chars))[least(count(n_chars), floor({q}::DOUBLE * count(n_chars))::BIGINT + 1)]"


@query("percentile_floor", f"SELECT lang, {_FLOOR.format(q=0.1)} AS p10, {_FLOOR.format(q=0.5)} AS p50, {_FLOOR.format(q=0.9)} AS p90, count(n_chars) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY lang")
def _(t: Tables) -> DataFrame:
    return stats.percentile_floor(t.documents, ["lang"], "n_chars", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query("length_percentiles", f"SELECT {_FLOOR.format(q=0.5)} AS p50, {_FLOOR.format(q=0.9)} AS p90, {_FLOOR.format(q=0.99)} AS p99, count(n_chars) AS n, max(n_chars) AS most FROM documents WHERE n_chars IS NOT NULL")
def _(t: Tables) -> DataFrame:
    found = stats.percentiles(t.documents, [], {"v": F.col("n_chars")}, {"p50": ("v", "floor", 0.5), "p90": ("v", "floor", 0.9), "p99": ("v", "floor", 0.99)})
    rest = t.documents.where("n_chars is not null").agg(F.count("*").alias("n"), F.max("n_chars").alias("most"))
    return found.crossJoin(rest).select(*(F.col(c).cast("bigint").alias(c) for c in ("p50", "p90", "p99")), "n", "most")  # one row each


@query("spread_stats", f"""
WITH q AS (SELECT source, {_FLOOR.format(q=0.1)} AS p10, {_FLOOR.format(q=0.5)} AS p50, {_FLOOR.format(q=0.9)} AS p90, round_even(CASE WHEN avg(n_chars) = 0 THEN NULL ELSE stddev_pop(n_chars) / avg(n_chars) END, 3) AS cv, min(n_chars) AS least, max(n_chars) AS most, count(*) AS n
FROM documents WHERE n_chars IS NOT NULL GROUP BY source)
SELECT *, round_even(p90 / greatest(p10, 1), 2) AS ratio FROM q""")
def _(t: Tables) -> DataFrame:
    return stats.spread(t.documents, ["source"], "n_chars")


@query("group_share_top1", "SELECT lang, c AS n, c / sum(c) OVER () AS share FROM (SELECT lang, count(*) AS c FROM documents WHERE lang IS NOT NULL GROUP BY lang) QUALIFY row_number() OVER (ORDER BY c DESC, lang) = 1")
def _(t: Tables) -> DataFrame:
    counts = t.documents.where("lang is not null").groupBy("lang").count()
    top = counts.agg(F.min_by("lang", F.struct(-F.col("count"), F.col("lang"))).alias("lang"), F.max("count").alias("n"), F.sum("count").alias("s"))
    return top.select("lang", "n", (F.col("n") / F.col("s")).alias("share"))


@query("max_per_group", "SELECT max(c) AS most FROM (SELECT count(*) AS c FROM examples GROUP BY topic)")
def _(t: Tables) -> DataFrame:
    return t.examples.groupBy("topic").count().agg(F.max("count").alias("most"))


_MEASURE = f"""
b AS (SELECT {_norm(_said('system'))} AS s, {_norm('split_part(topic, chr(124), 1)')} AS g, {_said('assistant')} AS a FROM examples),
m AS (SELECT count(*) AS examples, count(DISTINCT s) AS system_prompts, count(DISTINCT g) AS n_groups FROM b),
gs AS (SELECT max(c) AS top FROM (SELECT count(*) AS c FROM b GROUP BY g)),
ls AS (SELECT max(c) AS len_top FROM (SELECT count(*) AS c FROM b GROUP BY length(a))),
rs AS (SELECT sum(CASE WHEN c > 1 THEN c - 1 ELSE 0 END) AS rep FROM (SELECT count(*) AS c FROM b GROUP BY {_norm('a')})),
q AS (SELECT {_FLOOR.replace('n_chars', 'l').format(q=0.1)} AS p10, {_FLOOR.replace('n_chars', 'l').format(q=0.5)} AS p50, {_FLOOR.replace('n_chars', 'l').format(q=0.9)} AS p90, round(stddev_pop(l) / avg(l), 3) AS cv FROM (SELECT length(a) AS l FROM b) WHERE l IS NOT NULL),
d AS (SELECT examples, system_prompts, n_groups, round(top / examples, 4) AS largest_group_share, round(len_top / examples, 4) AS same_length_share, round(rep / examples, 4) AS duplicate_answer_share, p10, p50, p90, round(p90 / greatest(p10, 1), 2) AS ratio, cv FROM m, gs, ls, rs, q)"""
LIMITS = {"examples": ("least", 1000), "system_prompts": ("least", 3), "n_groups": ("least", 50), "largest_group_share": ("most", 0.10), "ratio": ("least", 1.6), "same_length_share": ("most", 0.25), "duplicate_answer_share": ("most", 0.30)}


def _measured(t: Tables) -> DataFrame:
    return quality.diversity(t.examples, quality.content_of("system"), text.normalize_group(F.col("topic"), False), assistant())


@query("diversity_measure", f"WITH {_MEASURE} SELECT * FROM d")
def _(t: Tables) -> DataFrame:
    return _measured(t)


_TIGHT = LIMITS | {"examples": ("least", 10_000_000), "ratio": ("least", 100.0), "largest_group_share": ("most", 0.01)}
_BROKEN = " UNION ALL ".join(f"SELECT '{m}' AS measure, {m}::DOUBLE AS value, '{s}' AS sense, {float(v)}::DOUBLE AS bound FROM d WHERE coalesce({m} {'<' if s == 'least' else '>'} {v}, true)" for m, (s, v) in _TIGHT.items())


@query("diversity_violations", f"WITH {_MEASURE} {_BROKEN}")
def _(t: Tables) -> DataFrame:
    return quality.violations(_measured(t), _TIGHT)


# The same patterns for an engine without look-around: the neighbours of a hit are read with it.
_I = text.SPACE[1:-1]
_NOT, _END = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
_PHONE = rf"(?:\+7|{_NOT}8)[{_I}\-(]{{0,3}}\p{{Nd}}{{3}}[{_I}\-)]{{0,3}}\p{{Nd}}{{3}}[{_I}\-]?\p{{Nd}}{{2}}[{_I}\-]?\p{{Nd}}{{2}}{_END}"
_EMAIL = rf"{_NOT}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{_END}"
_BIRTH = rf"(?i)(?:дат[аеы][{_I}]+рождения|год[{_I}]+рождения|родил(?:ся|ась)|{_NOT}г\.[{_I}]?р\.|{_NOT}д\.[{_I}]?р\.)[{_I}]*[:\-—]?[{_I}]*(?:0?[1-9]|[12]\p{{Nd}}|3[01])[.\-/](?:0?[1-9]|1[0-2])[.\-/](?:19|20)\p{{Nd}}{{2}}{_END}"
_HITS = ", ".join(f"coalesce(len(regexp_extract_all(m.content, '{p}')), 0) AS n_{k}" for k, p in (("phone", _PHONE), ("email", _EMAIL), ("birth_date", _BIRTH)))


@query("pii_hit_totals", f"SELECT sum(n_phone)::BIGINT AS n_phone, sum(n_email)::BIGINT AS n_email, sum(n_birth_date)::BIGINT AS n_birth_date, count(*) FILTER (WHERE n_phone + n_email + n_birth_date > 0) AS touched FROM (SELECT {_HITS} FROM (SELECT unnest(messages) AS m FROM examples))")
def _(t: Tables) -> DataFrame:
    each = t.examples.select(F.explode("messages").alias("m")).select(F.col("m.content").alias("content"))
    hits = quality.scrub(each, "content")
    return hits.agg(*(F.sum(f"n_{k}").alias(f"n_{k}") for k in text.PII), F.count_if((F.col("n_phone") + F.col("n_email") + F.col("n_birth_date")) > 0).alias("touched"))


@query("pii_hits_by_message", f"SELECT line_no, pos, n_phone, n_email, n_birth_date FROM (SELECT line_no, pos, {_HITS} FROM (SELECT line_no, unnest(range(0, len(messages)))::INT AS pos, unnest(messages) AS m FROM examples)) WHERE n_phone + n_email + n_birth_date > 0")
def _(t: Tables) -> DataFrame:
    each = t.examples.select("line_no", F.posexplode("messages").alias("pos", "m")).select("line_no", "pos", F.col("m.content").alias("content"))
    hits = quality.scrub(each, "content").drop("content")
    return hits.where("n_phone + n_email + n_birth_date > 0")


@query("pii_scrub")
def _(t: Tables) -> DataFrame:
    each = t.examples.select("line_no", F.posexplode("messages").alias("pos", "m")).select("line_no", "pos", F.col("m.content").alias("content"))
    return quality.scrub(each, "content")


_PRI = "sha256('42:' || doc_id::VARCHAR)"


def _documents_by_priority(t: Tables) -> DataFrame:
    return t.documents.withColumn("priority", hashing.priority(42, F.col("doc_id").cast("string")))


@query("hash_ordered_sample", f"SELECT doc_id, {_PRI} AS priority FROM documents ORDER BY priority, doc_id LIMIT 200")
def _(t: Tables) -> DataFrame:
    return _documents_by_priority(t).select("doc_id", "priority").orderBy("priority", "doc_id").limit(200)


@query("per_group_cap", f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_PRI}, doc_id) AS r FROM documents) WHERE r <= 3")
def _(t: Tables) -> DataFrame:
    return sampling.capped(_documents_by_priority(t).select("doc_id", "source", "priority"), "source", ["priority", "doc_id"], 3).select("doc_id", "source")


@query("length_strata", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, {_PRI}) AS r, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL)
SELECT doc_id, CASE WHEN r <= 50 THEN 'short' WHEN r > n - 50 THEN 'long' ELSE 'middle' END AS bucket FROM r""")
def _(t: Tables) -> DataFrame:
    return sampling.strata(_documents_by_priority(t).where("n_chars is not null").select("doc_id", "n_chars", "priority"), "n_chars", ["priority"], 50).select("doc_id", "bucket")


@query("stratified_schedule")
def _(t: Tables) -> DataFrame:
    rows = _documents_by_priority(t).where("n_chars is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_chars", "priority")
    return sampling.scheduled(sampling.strata(rows, "n_chars", ["priority"], 100), "source", ["priority", "doc_id"], 3, 300)


@query("nested_prefix", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_PRI}, doc_id) AS r FROM documents)
SELECT doc_id, r <= 100 AS in_v1, r <= 250 AS in_v2 FROM r WHERE r <= 250""")
def _(t: Tables) -> DataFrame:
    head = _documents_by_priority(t).select("doc_id", "priority").orderBy("priority", "doc_id").limit(250)
    rank = F.row_number().over(Window.orderBy("priority", "doc_id"))  # of the 250 rows of the larger prefix
    return head.withColumn("r", rank).select("doc_id", (F.col("r") <= 100).alias("in_v1"), (F.col("r") <= 250).alias("in_v2"))


@query("evenly_spaced_sample", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents),
p AS (SELECT DISTINCT round_even(i * (n - 1) / 6, 0)::BIGINT AS p FROM r, range(0, 7) t(i))
SELECT doc_id, place FROM r JOIN p ON place = p""")
def _(t: Tables) -> DataFrame:
    return sampling.evenly_spaced(t.documents.select("doc_id"), ["doc_id"], 7).withColumn("place", F.col("place").cast("bigint"))


RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}


@query("group_split_assign")
def _(t: Tables) -> DataFrame:
    return sampling.group_split(t.examples.withColumn("grp", text.normalize_group(F.coalesce("topic", F.lit("")), False)), "grp", RATIOS, 42)


@query("split_report", f"SELECT split, count(*) AS n, count(DISTINCT {_norm('split_part(topic, chr(124), 1)')}) AS n_groups, count(*) / (SELECT count(*) FROM split_examples) AS share FROM split_examples GROUP BY split")
def _(t: Tables) -> DataFrame:
    counts = t.split_examples.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct(text.normalize_group(F.col("topic"), False)).alias("n_groups"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a split


_SHINGLED = f"""
w AS (SELECT item_no AS id, regexp_extract_all({_norm('item_input')}, '{_W}') AS w FROM benchmark),
s AS (SELECT DISTINCT id, unnest([array_to_string(w[i:i + 3], ' ') for i in range(1, greatest(len(w) - 2, 2))]) AS s FROM w WHERE len(w) > 0),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) / (any_value(na.n) + any_value(nb.n) - count(*)) AS similarity FROM s a JOIN s b ON a.s = b.s AND a.id < b.id JOIN n na ON na.id = a.id JOIN n nb ON nb.id = b.id
  GROUP BY a.id, b.id HAVING count(*) / (any_value(na.n) + any_value(nb.n) - count(*)) >= 0.03)"""


def _benchmark_shingles(t: Tables) -> DataFrame:
    return dedup.shingled(t.benchmark.select(F.col("item_no").alias("id"), "item_input"), "id", text.normalize_text(F.col("item_input"), False), 4)


@query("jaccard_pairs", f"WITH {_SHINGLED} SELECT a, b, round(similarity, 9) AS similarity FROM pairs")
def _(t: Tables) -> DataFrame:
    s = _benchmark_shingles(t)
    return dedup.overlap_pairs(s, s, 0.03, True).withColumn("similarity", F.round("similarity", 9))


def _question_shingles(t: Tables) -> DataFrame:
    return dedup.shingled(t.examples.select(F.col("line_no").alias("id"), user().alias("q")), "id", text.question_key(F.col("q"), False), 4)


_QUESTIONS = f"""
w AS (SELECT line_no AS id, regexp_extract_all({_norm(_key(_said('user')))}, '{_W}') AS w FROM examples),
s AS (SELECT DISTINCT id, unnest([array_to_string(w[i:i + 3], ' ') for i in range(1, greatest(len(w) - 2, 2))]) AS s FROM w WHERE len(w) > 0),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id),
pairs AS (SELECT a, b FROM c JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE k / (na.n + nb.n - k) >= 0.85)"""


@query("near_dup_self_pairs", f"WITH {_QUESTIONS} SELECT a, b FROM pairs")
def _(t: Tables) -> DataFrame:
    s = _question_shingles(t)
    return dedup.overlap_pairs(s, s, 0.85, True).select("a", "b")


@query("near_dup_greedy")
def _(t: Tables) -> DataFrame:
    s = _question_shingles(t)
    return dedup.greedy_drops(dedup.overlap_pairs(s, s, 0.85, True))


def _question_strings(t: Tables) -> DataFrame:
    words = text.words(text.question_key(user(), False))
    return t.examples.select(F.col("line_no").alias("id"), F.array_distinct(text.ngrams(words, 4)).alias("shingles"))


_SIGNED = f"""w AS (SELECT line_no AS id, regexp_extract_all({_norm(_key(_said('user')))}, '{_W}') AS w FROM examples),
s AS (SELECT DISTINCT id, unnest([array_to_string(w[i:i + 3], ' ') for i in range(1, greatest(len(w) - 2, 2))]) AS s FROM w WHERE len(w) > 0),
h AS (SELECT id, ('0x' || md5(s)[1:8])::BIGINT >> 1 AS x FROM s),
p AS (SELECT k, 1 + (k * 1103515245 + 12345) % 2147483646 AS a, (k * 69069 + 1) % 2147483647 AS b FROM range(0, 128) t(k)),
m AS (SELECT id, k, min((x * a + b) % 2147483647) AS v FROM h, p GROUP BY id, k), g AS (SELECT id, list(v ORDER BY k) AS signature FROM m GROUP BY id)"""


@query("minhash_signature", f"WITH {_SIGNED} SELECT id, array_to_string(signature, ',') AS signature FROM g")
def _(t: Tables) -> DataFrame:
    return dedup.minhash(_question_strings(t), "id").select("id", F.array_join("signature", ",").alias("signature"))


@query("minhash_lsh_pairs", f"""WITH {_SIGNED}, k AS (SELECT id, i, signature[8 * i + 1:8 * i + 8] AS part FROM g, range(0, 16) t(i)),
c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.i = y.i AND x.part = y.part AND x.id < y.id)
SELECT a, b, len(list_filter(list_zip(ga.signature, gb.signature), lambda e: e[1] = e[2])) / 128 AS estimate FROM c JOIN g ga ON ga.id = a JOIN g gb ON gb.id = b""")
def _(t: Tables) -> DataFrame:
    return dedup.lsh_pairs(dedup.minhash(_question_strings(t), "id"), "id", 16)


@query("ordered_digest", "SELECT r_name, sha256(array_to_string(list_sort(list(n_name)), chr(10))) AS digest FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(hashing.ordered_digest(F.col("n_name")).alias("digest"))


@query("canonical_fingerprint", "SELECT event_id, sha256(replace(props, ': ', ':')) AS digest FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", hashing.fingerprint(F.col("props")).alias("digest"))


@query("hex_digest_check", "SELECT request_id, run, seq FROM warmup_fixed WHERE model_sha256 IS NULL OR NOT regexp_full_match(model_sha256, '[0-9a-f]{64}')")
def _(t: Tables) -> DataFrame:
    return t.warmup_fixed.where(~ledger.is_digest(F.col("model_sha256"))).select("request_id", "run", "seq")


@query("case_first_match_group", "SELECT p_type, CASE WHEN contains(p_name, 'red') THEN 'red' WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_name, 'small') THEN 'small' ELSE 'other' END AS grp, count(*) AS n FROM part GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    grp = quality.first_reason([(m, F.contains("p_name", F.lit(m))) for m in ("red", "ring", "small")])
    return t.part.groupBy("p_type", F.coalesce(grp, F.lit("other")).alias("grp")).agg(F.count("*").alias("n"))


@query("group_share_of_total", """
WITH x AS (SELECT p_type, p_brand, p_size, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1 AS tied FROM part)
SELECT p_type, count(*) AS modules, array_to_string(list_sort(list(DISTINCT p_brand)), ', ') AS shapes, sum(CASE WHEN tied THEN 0 ELSE p_size END)::BIGINT AS params, sum(CASE WHEN tied THEN p_size ELSE 0 END)::BIGINT AS tied_params,
  sum(CASE WHEN tied THEN 0 ELSE p_size END) / (SELECT sum(p_size) FROM x WHERE NOT tied) AS share FROM x GROUP BY p_type""")
def _(t: Tables) -> DataFrame:
    x = t.part.select("p_type", "p_brand", "p_size", (F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey")) > 1).alias("tied"))
    table = x.groupBy("p_type").agg(F.count("*").alias("modules"), F.array_join(F.array_sort(F.collect_set("p_brand")), ", ").alias("shapes"), F.sum(F.when(F.col("tied"), 0).otherwise(F.col("p_size"))).alias("params"), F.sum(F.when(F.col("tied"), F.col("p_size")).otherwise(0)).alias("tied_params"))
    return table.withColumn("share", F.col("params") / F.sum("params").over(Window.partitionBy()))  # one row a group


@query("pivot_versions", "SELECT traffic, count(*) FILTER (WHERE app_version = 'A') AS A, count(*) FILTER (WHERE app_version = 'B') AS B FROM warmup_fixed GROUP BY traffic")
def _(t: Tables) -> DataFrame:
    return t.warmup_fixed.groupBy("traffic").pivot("app_version", ["A", "B"]).agg(F.count(F.lit(1))).na.fill(0)


@query("filter_len_and_script", f"SELECT line_no FROM examples WHERE length({_said('user')}) BETWEEN 15 AND 180 AND length({_said('assistant')}) BETWEEN 2 AND 240 AND regexp_matches({_said('user')}, '[А-Яа-яЁё]')")
def _(t: Tables) -> DataFrame:
    return t.examples.where(F.length(user()).between(15, 180) & F.length(assistant()).between(2, 240) & user().rlike("[А-Яа-яЁё]")).select("line_no")


@query("accumulation_groups", "SELECT grp, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY seq_no) - 1) // 8 // 4 AS grp FROM encode_example) GROUP BY grp")
def _(t: Tables) -> DataFrame:
    ranked = sampling.global_rank(t.encode_example.select("seq_no"), ["seq_no"], "r")
    return ranked.groupBy(F.expr("(r - 1) div 32").alias("grp")).agg(F.count("*").alias("n"))


@query("every_kth_or_last", "SELECT seq_no FROM encode_example WHERE seq_no % 50 = 0 OR seq_no = (SELECT max(seq_no) FROM encode_example)")
def _(t: Tables) -> DataFrame:
    last = t.encode_example.agg(F.max("seq_no").alias("last"))
    return t.encode_example.select("seq_no").crossJoin(F.broadcast(last)).where("seq_no % 50 = 0 or seq_no = last").select("seq_no")  # one row


@query("share_within_group", "SELECT seq_no, supervised / nullif(sum(supervised) OVER (PARTITION BY seq_no // 8), 0) AS weight FROM encode_example")
def _(t: Tables) -> DataFrame:
    return t.encode_example.select("seq_no", F.try_divide("supervised", F.sum("supervised").over(Window.partitionBy(F.expr("seq_no div 8")))).alias("weight"))


@query("zip_positional", "SELECT line_no, m.pos AS pos, m.role AS role FROM (SELECT line_no, unnest([{'pos': i, 'role': messages[i].role} for i in range(1, len(messages) + 1)]) AS m FROM split_examples)")
def _(t: Tables) -> DataFrame:
    zipped = F.arrays_zip(F.sequence(F.lit(1), F.size("messages")).cast("array<bigint>").alias("pos"), F.col("messages.role").alias("role"))
    return t.split_examples.where(F.size("messages") > 0).select("line_no", F.inline(zipped).alias("pos", "role"))


@query("split_last_segment", "SELECT pod, list_extract(string_split(pod, '-'), -1) AS tail, count(*) AS n FROM warmup_fixed GROUP BY pod")
def _(t: Tables) -> DataFrame:
    return t.warmup_fixed.groupBy("pod").agg(F.count("*").alias("n")).select("pod", F.element_at(F.split("pod", "-"), -1).alias("tail"), "n")


@query("values_choices_rotate", """
WITH c AS (SELECT item_no, choices, (item_no % len(choices))::INT AS k FROM benchmark WHERE len(choices) > 0)
SELECT item_no, array_to_string([chr(64 + i::INT) || ': ' || list_concat(choices[len(choices) - k + 1:], choices[1:len(choices) - k])[i] for i in range(1, len(choices) + 1)], '; ') AS line FROM c""")
def _(t: Tables) -> DataFrame:
    rows = t.benchmark.where(F.size("choices") > 0).withColumn("k", F.expr("int(item_no % size(choices))"))
    turned = F.concat(F.slice("choices", F.size("choices") - F.col("k") + 1, F.col("k")), F.slice("choices", 1, F.size("choices") - F.col("k")))
    lines = F.transform(turned, lambda c, i: F.concat(F.chr(i + 65), F.lit(": "), c))
    return rows.select("item_no", F.array_join(lines, "; ").alias("line"))


@query("answers_equal", "SELECT id, split, 'left' AS side FROM (SELECT id, split FROM encode_example EXCEPT ALL SELECT id, split FROM split_examples) UNION ALL SELECT id, split, 'right' FROM (SELECT id, split FROM split_examples EXCEPT ALL SELECT id, split FROM encode_example)")
def _(t: Tables) -> DataFrame:
    from karst.operators.evaluate import different

    return different(t.encode_example.select("id", "split"), t.split_examples.select("id", "split"))


@query("build_chat_record", f"""
SELECT line_no, CASE WHEN {_said('system')} IS NULL THEN {_said('user')} ELSE 'Контекст:' || chr(10) || {_said('system')} || chr(10) || chr(10) || 'Вопрос:' || chr(10) || {_said('user')} END AS user_content, {_said('assistant')} AS assistant_content FROM examples""")
def _(t: Tables) -> DataFrame:
    made = t.examples.select("line_no", quality.chat_record(user(), assistant(), quality.content_of("system")).alias("m"))
    return made.select("line_no", F.get("m", F.lit(1))["content"].alias("user_content"), F.get("m", F.lit(2))["content"].alias("assistant_content"))


@query("chat_accessors", "SELECT line_no, sha256(messages[2].content) AS user_digest, sha256(messages[3].content) AS assistant_digest FROM split_examples")
def _(t: Tables) -> DataFrame:
    at = lambda i: F.get("messages", F.lit(i))["content"]
    return t.split_examples.select("line_no", F.sha2(at(1), 256).alias("user_digest"), F.sha2(at(2), 256).alias("assistant_digest"))


@query("first_user_message", f"SELECT line_no, {_said('user')} AS content FROM examples")
def _(t: Tables) -> DataFrame:
    return t.examples.select("line_no", user().alias("content"))


@query("split_prompt_answer", "SELECT line_no, len(messages) - 1 AS n_prompt, messages[-1].content AS answer FROM examples WHERE messages[-1].role = 'assistant'")
def _(t: Tables) -> DataFrame:
    last = F.try_element_at("messages", F.lit(-1))
    return t.examples.where(last["role"] == "assistant").select("line_no", (F.size("messages") - 1).cast("bigint").alias("n_prompt"), last["content"].alias("answer"))


@query("last_per_key", "SELECT run, seq, status FROM (SELECT run, seq, status, row_number() OVER (PARTITION BY run ORDER BY finished_epoch DESC NULLS LAST, seq DESC) AS r FROM (SELECT DISTINCT run, seq, status, finished_epoch FROM warmup_fixed)) WHERE r = 1")
def _(t: Tables) -> DataFrame:
    rows = t.warmup_fixed.select("run", "seq", "status", F.coalesce("finished_epoch", F.lit(float("-inf"))).alias("f"))
    return ledger.latest(rows, "run", ["f", "seq"]).drop("f")


@query("request_validation", f"""
SELECT request_id, seq, CASE WHEN payload.prompt IS NULL OR {_strip('payload.prompt')} = '' THEN 'prompt' WHEN length(payload.prompt) > 1000 THEN 'length' WHEN payload.chunks NOT BETWEEN 1 AND 64 THEN 'chunks' WHEN payload.cpu_iterations < 0 THEN 'iterations' END AS fault FROM warmup_fixed""")
def _(t: Tables) -> DataFrame:
    fault = quality.first_reason([("prompt", text.is_blank(F.col("payload.prompt"))), ("length", F.length("payload.prompt") > 1000), ("chunks", ~F.col("payload.chunks").between(1, 64)), ("iterations", F.col("payload.cpu_iterations") < 0)])
    return t.warmup_fixed.select("request_id", "seq", fault.alias("fault"))
