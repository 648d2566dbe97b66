"""Registered queries of the operators, with DuckDB SQL where SQL can state
them over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op6_near_dup")
def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .line_dedup import dedup_lines
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


_WORDS = ("regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT DISTINCT item_id::VARCHAR AS item, {_WORDS.format('text')} AS w FROM benchmark
      WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS l, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
       FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS s
       FROM d, (SELECT DISTINCT l FROM bw) AS ls, unnest(range(1, len(w) - l + 2)) AS t(i)),
m AS (SELECT doc_id, i, l, item FROM dw JOIN bw USING (l, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + l)) AS t(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items,
          array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


@register("op1_decontaminate", OP1_SQL)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import decontaminate
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    return digest_pieces(pack(table(spark, sf_dir, "documents")))


def digest_pieces(pieces: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "source")


@register("op3_langid")
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify
    return identify(table(spark, sf_dir, "documents"))


@register("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .suffix_dedup import remove_repeats
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality
    return quality(table(spark, sf_dir, "documents"), with_text=False)


SHARD_BYTES = 1 << 20

OP10_SQL = f"""
WITH k AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
n AS (SELECT d, h >> (60 - d) AS p, sum(n_bytes) AS b, count(*) AS m
      FROM k, unnest(range(0, 61)) AS t(d) GROUP BY ALL),
leaf AS (SELECT doc_id, min(n_bytes) AS n_bytes, min(k.h) AS h, min(n.d) AS depth
         FROM k JOIN n ON n.p = k.h >> (60 - n.d) WHERE n.b <= {SHARD_BYTES} OR n.m = 1 GROUP BY doc_id)
SELECT doc_id, n_bytes, left(lpad(bin(h), 60, '0'), depth::INT) AS shard, depth::INT AS depth FROM leaf"""


@register("op10_sharding", OP10_SQL)
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards
    return assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


@register("op9_training_order")
def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ordering import write_order
    from .scratch import scratch_path
    return write_order(table(spark, sf_dir, "documents"), scratch_path(spark, "order"))


LICENSE_FILE = r"^[^\n]*[Ll][Ii][Cc][Ee][Nn][SsCc][Ee]"  # a first line that names a licence


def _op2_sql() -> str:
    from .licenses import BLOCK, TEMPLATES
    rows = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
    white = "[ \\t\\n\\x0B\\f\\r]"
    return f"""
WITH tp AS (SELECT * FROM (VALUES {rows}) AS v(template, license, txt)),
tw AS (SELECT template, license, word, count(*) AS tf
       FROM (SELECT template, license, unnest({_WORDS.format('txt')}) AS word FROM tp) GROUP BY ALL),
idf AS (SELECT word, ln((1.0 + {len(TEMPLATES)}) / (1.0 + count(*))) + 1.0 AS idf FROM tw GROUP BY word),
tv AS (SELECT template, license, tw.word, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS w
       FROM tw JOIN idf USING (word)),
d AS (SELECT doc_id, concat_ws('/', source, lang) AS dir,
      concat_ws('/', source, lang, doc_id::VARCHAR) AS path, text,
      coalesce(regexp_matches(text, '{LICENSE_FILE}'), false) AS is_file FROM documents),
u AS (SELECT doc_id, pos, {_WORDS.format('raw')} AS w FROM (
       SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM d)
       UNION ALL SELECT doc_id, -1, {_WORDS.format('text')} FROM d WHERE is_file
       UNION ALL SELECT doc_id, {BLOCK}, {_WORDS.format('b')} FROM (
       SELECT doc_id, string_split_regex(regexp_replace(text, '^{white}+', ''), '\\n{white}*\\n')[1] AS b FROM d) WHERE contains(b, chr(10))),
uw AS (SELECT doc_id, pos, word, count(*) AS tf FROM (SELECT doc_id, pos, unnest(w) AS word FROM u) GROUP BY ALL),
uv AS (SELECT doc_id, pos, uw.word, idf, tf * coalesce(idf, ln(1.0 + {len(TEMPLATES)}) + 1.0) AS v FROM uw LEFT JOIN idf USING (word)),
un AS (SELECT doc_id, pos, sqrt(sum(v * v)) AS norm FROM uv GROUP BY ALL),
sc AS (SELECT doc_id, pos, template, license, round(sum(v * w) / any_value(norm), 9) AS score
       FROM uv JOIN tv USING (word) JOIN un USING (doc_id, pos) GROUP BY doc_id, pos, template, license),
b AS (SELECT * FROM sc WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY score DESC, template) = 1),
own AS (SELECT doc_id, license, score FROM b WHERE pos >= 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) = 1),
f AS (SELECT doc_id, license, score FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) = 1),
dl AS (SELECT dir, license, score FROM d JOIN f USING (doc_id) WHERE is_file
       QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
nd AS (SELECT x.dir, dl.license, dl.score, dl.dir AS from_dir FROM (SELECT DISTINCT dir FROM d) x
       JOIN dl ON x.dir = dl.dir OR starts_with(x.dir, dl.dir || '/')
       QUALIFY row_number() OVER (PARTITION BY x.dir ORDER BY length(dl.dir) DESC) = 1)
SELECT d.doc_id, d.path, coalesce(own.license, nd.license) AS license,
       CASE WHEN own.license IS NOT NULL THEN own.score ELSE nd.score END AS score,
       CASE WHEN own.license IS NOT NULL THEN 'own' WHEN nd.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN own.license IS NULL THEN nd.from_dir END AS from_dir
FROM d LEFT JOIN own USING (doc_id) LEFT JOIN nd ON nd.dir = d.dir"""


@register("op2_licenses", _op2_sql())
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path of their own: source and language are taken as
    directories, and a document whose first line names a licence stands for
    the licence file of its directory."""
    from pyspark.sql import functions as F

    from .licenses import scan
    docs = table(spark, sf_dir, "documents")
    return scan(docs, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")),
                license_file=F.col("text").rlike(LICENSE_FILE))


@register("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
dn AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM d),
c AS (SELECT count(*) FILTER (n > 0) AS nd, sum(n)::BIGINT AS l FROM dn),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS qtf FROM (
      SELECT item_id, unnest({_WORDS.format('text')}) AS term FROM (
      SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM df, c),
s AS (SELECT item_id, doc_id, r, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN dn USING (r), c GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10"""


@register("op12_search", OP12_SQL)
def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# the CRC of every feature by the table of 256 values
OP11_SQL = f"""
WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
             FROM range(256) AS r(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
f AS (SELECT r, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, range(1, 4) AS ks(k), unnest(range(1, len(w) - k + 2)) AS t(i)),
fb AS (SELECT array_to_string(w[i:i + k - 1], ' ') AS g FROM b, range(1, 4) AS ks(k), unnest(range(1, len(w) - k + 2)) AS t(i)),
g AS (SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM f UNION SELECT g FROM fb)),
crc AS (SELECT g, xor(list_reduce([4294967295] || list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT),
        lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295) % 10000 AS k FROM g, tab),
s AS (SELECT k, count(*) AS s FROM f JOIN crc USING (g) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM fb JOIN crc USING (g) GROUP BY k),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
gain AS (SELECT k, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000)) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain
         FROM s LEFT JOIN t USING (k), n),
w AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN crc USING (g) JOIN gain USING (k) GROUP BY r),
x AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM d LEFT JOIN w USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS o, count(*) OVER () AS c FROM x WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score::BIGINT AS score, CASE WHEN o <= 5 * c // 100 THEN o END AS rank, n_words FROM x LEFT JOIN o USING (r)"""


@register("op11_resample", OP11_SQL)
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
