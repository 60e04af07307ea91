"""Named queries over corpus checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import corpus as C
from millrace.plans.book import Book
from millrace.plans.log import turn_log
from millrace.session import table

book = Book()
#: The tables have no split; a document's is drawn from its source's number.
SPLIT = "(ARRAY['train', 'dev', 'test', 'demo'])[CAST(substr(source, 4) AS INTEGER) % 4 + 1]"


def _split_docs(spark, sf_dir):
    at = (F.substring("source", 4, 9).cast("int") % 4 + 1).cast("int")
    splits = F.array(*map(F.lit, ("train", "dev", "test", "demo")))
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.element_at(splits, at).alias("split"))


def _duplicates_sql(key):
    return f"SELECT sha256({key}) AS key_sha256, list_sort(list(DISTINCT {SPLIT})) AS splits, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT {SPLIT}) > 1"


@book.query(_duplicates_sql("text"))
def cross_split_exact_duplicates(spark, sf_dir):
    return C.across_splits(_split_docs(spark, sf_dir), F.col("text"), "split")


@book.query(_duplicates_sql(r"trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g'))"))
def cross_split_normalized_duplicates(spark, sf_dir):
    return C.across_splits(_split_docs(spark, sf_dir), F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\x0B\f\r]+", " ")), "split")


@book.query()
def near_duplicates_5gram_jaccard(spark, sf_dir):
    return C.near_duplicates(_split_docs(spark, sf_dir), "doc_id", "text", "split")


_KEY = "' ' || array_to_string(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), ' ') || ' '"


@book.query(f"SELECT doc_id AS doc, item_id AS item FROM documents d, benchmark b WHERE contains({_KEY.format('d.text')}, {_KEY.format('b.text')})")
def benchmark_contamination(spark, sf_dir):
    return C.containing_phrases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


_ITEM_SPLIT = "['train', 'dev', 'test'][item_id % 3 + 1]"


@book.query(f"""SELECT doc_id AS doc, item_id AS item, {SPLIT} AS split, {_ITEM_SPLIT} AS item_split FROM documents d, benchmark b
WHERE contains({_KEY.format('d.text')}, {_KEY.format('b.text')}) AND {SPLIT} <> {_ITEM_SPLIT}""")
def protected_phrase_leaks(spark, sf_dir):
    """Protected phrases of one split that stand in a document of another."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    docs = _split_docs(spark, sf_dir)
    found = C.containing_phrases(docs, items, "doc_id", "text", "item_id", "text")
    own = F.element_at(F.array(*map(F.lit, ("train", "dev", "test"))), (F.col("item") % 3 + 1).cast("int"))
    met = found.join(docs.select(F.col("doc_id").alias("doc"), "split"), "doc").withColumn("item_split", own)
    return met.where("split <> item_split").select("doc", "item", "split", "item_split")


@book.query(r"""WITH f AS (SELECT doc_id, [CASE WHEN contains(text, '!!') THEN {code: 'shouting', severity: 'review'} END, CASE WHEN regexp_matches(text, '[#*$%&|<>]{2,}') THEN {code: 'symbols', severity: 'error'} END,
 CASE WHEN length(text) < 40 THEN {code: 'short', severity: 'review'} END, CASE WHEN regexp_matches(text, '[\x00-\x08\x0E-\x1F]') THEN {code: 'control', severity: 'error'} END] AS i FROM documents)
SELECT doc_id, i.code AS code, i.severity AS severity FROM (SELECT doc_id, unnest(list_filter(i, lambda x: x IS NOT NULL)) AS i FROM f)""")
def quality_flags_issue_report(spark, sf_dir):
    t = F.col("text")
    rules = {
        "shouting": ("review", t.contains("!!")), "symbols": ("error", t.rlike(r"[#*$%&|<>]{2,}")),
        "short": ("review", F.char_length(t) < 40), "control": ("error", t.rlike(r"[\x00-\x08\x0E-\x1F]")),
    }
    return C.issues(table(spark, sf_dir, "documents"), "doc_id", rules)


def _gram_sql(n, first, most):
    grams = f"list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')))"
    picked = f"[array_to_string(w[1:{n}], ' ')]" if first else grams
    return f"""WITH w AS (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
g AS (SELECT DISTINCT doc, unnest({picked}) AS gram FROM w WHERE len(w) >= {n}) SELECT gram, count(*) AS n_docs FROM g GROUP BY gram HAVING count(*) > {most}"""


def _doc_words(spark, sf_dir, least):
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), T.words(F.col("text")).alias("w"))
    return words.where(F.size("w") >= least)


#: An opening of four words is overused in more than three documents, eight words in more than two.
@book.query(_gram_sql(4, True, 3))
def opening_ngram_overuse(spark, sf_dir):
    return C.overused(_doc_words(spark, sf_dir, 4), "doc", F.array(F.array_join(F.slice("w", 1, 4), " ")), 3)


@book.query(_gram_sql(8, False, 2))
def eight_gram_overuse(spark, sf_dir):
    return C.overused(_doc_words(spark, sf_dir, 8), "doc", T.token_ngrams(F.col("w"), 8), 2)


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))"


@book.query(f"""WITH a AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations WHERE role = 'assistant'), p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM a)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(w, b))) = 0 THEN 0 ELSE len(list_intersect(w, b)) / len(list_distinct(list_concat(w, b))) END, 6) AS similarity FROM p WHERE b IS NOT NULL""")
def previous_answer_similarity(spark, sf_dir):
    answers = turn_log(spark, sf_dir).where("role = 'assistant'").select("conv_id", "turn", F.array_distinct(T.words(F.col("text"))).alias("w"))
    pairs = answers.withColumn("b", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    return pairs.select("conv_id", "turn", F.round(T.jaccard(F.col("w"), F.col("b"), 0.0), 6).alias("similarity"))


_PART = "CAST(sum(CAST(('0x' || h[{0}:{1}])::UBIGINT AS HUGEINT)) AS VARCHAR)"


@book.query(f"""WITH e AS (SELECT source, sha256(doc_id || ':' || lang) AS h FROM documents)
SELECT source, count(*) AS n, sha256(concat_ws('|', count(*), {', '.join(_PART.format(16 * i + 1, 16 * i + 16) for i in range(4))})) AS seal FROM e GROUP BY source""")
def split_seal(spark, sf_dir):
    return C.seal(table(spark, sf_dir, "documents"), ["source"], F.concat(F.col("doc_id").cast("string"), F.lit(":"), "lang"))


@book.query(r"""WITH w AS (SELECT item_id AS doc, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
g AS (SELECT doc, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))))) AS gram FROM w),
v AS (SELECT doc, ('0x' || sha256(gram)[1:8])::UBIGINT % 2048 AS bucket, sum(CASE WHEN ('0x' || sha256(gram)[9:9])::INTEGER % 2 = 0 THEN 1 ELSE -1 END) AS weight FROM g GROUP BY ALL),
n AS (SELECT doc, sqrt(sum(weight * weight)) AS norm FROM v GROUP BY doc),
d AS (SELECT x.doc AS a, y.doc AS b, sum(x.weight * y.weight) AS dot FROM v x JOIN v y ON x.bucket = y.bucket AND y.doc = x.doc + 1 GROUP BY ALL)
SELECT na.doc AS a, nb.doc AS b, round(coalesce(dot, 0) / (na.norm * nb.norm), 6) AS cosine FROM n na JOIN n nb ON nb.doc = na.doc + 1 LEFT JOIN d ON d.a = na.doc AND d.b = nb.doc""")
def hashed_embedding_cosine(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    pairs = items.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"))
    return C.cosine(C.hashed_vectors(items, "item_id", "text"), pairs).withColumn("cosine", F.round("cosine", 6))


@book.query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, vec_id, round(c, 6) AS cosine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS INTEGER) AS place FROM s QUALIFY place <= 10""")
def embedding_cosine_topk(spark, sf_dir):
    found = C.top_cosine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 10)
    return found.withColumn("cosine", F.round("cosine", 6))


@book.query("""WITH f AS (SELECT DISTINCT source FROM documents), need AS (SELECT source, unnest([0, 1]) AS quality, toxic FROM f, (SELECT unnest([0, 1]) AS toxic)),
have AS (SELECT DISTINCT source, quality, toxic FROM documents JOIN labels USING (doc_id)) SELECT source, quality, toxic FROM need EXCEPT SELECT source, quality, toxic FROM have""")
def missing_family_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    kinds = F.explode(F.array(*(F.struct(F.lit(q).alias("quality"), F.lit(t).alias("toxic")) for q in (0, 1) for t in (0, 1)))).alias("k")
    need = docs.select("source").distinct().select("source", kinds).select("source", "k.*")
    have = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return need.join(have, ["source", "quality", "toxic"], "left_anti")


@book.query("""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS a, lead(regexp_extract_all(lower(text), '[a-z]+')) OVER (ORDER BY item_id) AS b FROM benchmark)
SELECT item_id, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) + abs(len(a) - len(b)) AS n_different, len(a) = len(b) AS same_length FROM w WHERE b IS NOT NULL""")
def lookup_contrast(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    items = table(spark, sf_dir, "benchmark").select("item_id", words.alias("a"))
    pairs = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")
    differs = F.zip_with("a", "b", lambda x, y: ~x.eqNullSafe(y))
    return pairs.select("item_id", F.size(F.filter(differs, lambda d: d)).cast("long").alias("n_different"), (F.size("a") == F.size("b")).alias("same_length"))
