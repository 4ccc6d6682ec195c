"""The thin ``opN_<name>`` queries over the standard tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.bpe import bpe_encode
from quernel.llm.common import LOWER, UPPER, dealt, scratched, staged
from quernel.llm.filteraudit import filter_audit
from quernel.llm.langid import identify_language
from quernel.llm.linededup import drop_repeated_lines
from quernel.llm.lmscore import cross_entropy_difference
from quernel.llm.media import media_columns
from quernel.llm.mixing import copies
from quernel.llm.neardup import near_duplicates
from quernel.llm.packing import pack_documents
from quernel.llm.pii import KINDS, count_kind, personal_data, spans_text
from quernel.llm.repair import conversation_digests, repair_report, repaired_turns
from quernel.llm.topk import top_k
from quernel.llm.urls import LINK, Rule, judge

#: Place of the public vocabularies on this machine; a parameter of the operators.
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

#: The rules of the standard query.
RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES).select("page_id", "host", "path", "rule", "verdict")


UPPER_LOWER = f"'{UPPER}', '{LOWER}'"
#: The same rules; PageRank as the sum over walks of growing length, up to 200 links.
OP4_SQL = rf"""
WITH RECURSIVE cut AS (SELECT row_number() OVER () AS rid, page_id, html, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), {UPPER_LOWER}) AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
rules(verdict, h, p) AS (VALUES {", ".join(str(tuple(r)) for r in RULES)}),
hits AS (SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS kind FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid),
ruled AS (SELECT cut.*, rule, kind FROM cut LEFT JOIN hits USING (rid)),
seeds AS (SELECT kind, host, count(*) / sum(count(*)) OVER (PARTITION BY kind) AS mass FROM ruled WHERE kind IS NOT NULL GROUP BY kind, host),
links AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1), lambda x: translate(x, {UPPER_LOWER})))) AS dst FROM cut),
edges AS (SELECT src, dst, count(*) AS w FROM links WHERE src <> dst AND src <> '' GROUP BY src, dst),
ways AS (SELECT 'allow' AS kind, src, dst, w FROM edges UNION ALL SELECT 'block', dst, src, w FROM edges),
flow AS (SELECT kind, src, dst, 0.85 * w / sum(w) OVER (PARTITION BY kind, src) AS share FROM ways),
walks(n, kind, host, score) AS (SELECT 0, kind, host, 0.15::DOUBLE * mass FROM seeds
    UNION ALL SELECT n + 1, walks.kind, dst, sum(score * share) FROM walks JOIN flow ON flow.kind = walks.kind AND src = host WHERE n < 200 GROUP BY n, walks.kind, dst),
scores AS (SELECT host, coalesce(sum(score) FILTER (kind = 'allow'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'block'), 0) AS distrust FROM walks GROUP BY host)
SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict FROM ruled LEFT JOIN scores USING (host)
"""


def op5_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return cross_entropy_difference(docs, labels, (F.col("quality") == 1) & (F.col("toxic") == 0))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_encode(docs, f"{TOKENIZERS}/byte_bpe_50k.json", keep_ids=False)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10),
marked AS (SELECT rid, line, pos, keyed.k IN (SELECT k FROM repeated) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked JOIN docs USING (rid) GROUP BY rid, doc_id
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"])
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same with sums over sources, classes and slots; targets by filling sources in order of their limit for each unit of weight.
OP9_SQL = r"""
WITH docs AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat_ws('|', coalesce('+' || doc_id, '-'), coalesce('+' || text, '-'), coalesce('+' || source, '-'))) AS k FROM documents),
sources AS (SELECT s, sum(size)::HUGEINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY s = '', s) - 1) % 3 + 1]::HUGEINT AS w FROM docs GROUP BY s),
filled AS (SELECT *, row_number() OVER f AS i, 3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER e, 0) AS twice_left, sum(w) OVER () - coalesce(sum(w) OVER e, 0) AS open_w FROM sources
    WINDOW f AS (ORDER BY 2 * source_size / w, s), e AS (ORDER BY 2 * source_size / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first AS (SELECT min(i) AS i FROM filled WHERE twice_left * w <= 4 * source_size * open_w),
level AS (SELECT f.i, f.twice_left, f.open_w FROM filled f JOIN first ON f.i = first.i),
targets AS (SELECT s, source_size, CASE WHEN filled.i < coalesce(level.i, 1000000000) THEN (2 * source_size)::DOUBLE ELSE (level.twice_left * w)::DOUBLE / (2 * level.open_w)::DOUBLE END AS target,
    CASE WHEN source_size = 0 THEN 0 WHEN filled.i < coalesce(level.i, 1000000000) THEN 33554432 ELSE (level.twice_left * w * 16777216) // (2 * level.open_w) // source_size END AS expected
    FROM filled LEFT JOIN level ON true),
classed AS (SELECT *, length(bin(size + 1)) * 8 + list_position(['000', '001', '010', '011', '100', '101', '110', '111'], rpad(substr(bin(size + 1), 2, 3), 3, '0')) AS c FROM docs),
slotted AS (SELECT *, ('0x' || substr(k, 1, 15))::BIGINT % ceil(count(*) OVER (PARTITION BY s, c) / 256.0)::BIGINT AS slot FROM classed),
placed AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY c, slot, size, k) AS upto, ('0x' || substr(md5('17#' || s), 1, 6))::BIGINT AS start FROM slotted)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, size * (((start + upto * expected::BIGINT) >> 24) - ((start + (upto - 1) * expected::BIGINT) >> 24)) AS taken
FROM placed JOIN targets USING (s)
"""


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The standard damage: by a checksum of conversation and turn some rows go, lose text or marks, come twice, or change their role."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind")).where(F.col("kind") != 0)
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


@scratched
def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """The report of every original conversation after the standard damage, with the digest of its repair."""
    turns = damaged(conversations)
    report = staged(repair_report(turns), "repairs", kept=True)
    digests = conversation_digests(repaired_turns(turns, report))
    out = conversations.select("conv_id").distinct()
    for part in (report, digests):
        own = part.withColumnRenamed("conv_id", "__conv")
        out = out.join(own, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: Texts of the same damage and repair: the checksum bit by bit, the repair by dynamic programming over turns, up to two inserts before each.
OP11_SQL = r"""
WITH RECURSIVE told AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
    lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), range(8)), lambda c, bit: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc FROM conversations),
kinds AS (SELECT *, xor(crc, 4294967295) % 20 AS kind FROM told),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM kinds, range(CASE kind WHEN 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again,
    lag(left(role, 1)) OVER w || left(role, 1) AS pair, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))),
rows AS (SELECT conv_id, turn, i, role, text, pair, left(role, 1) AS initial, core = '' AS blank, core <> '' AND again AS dup, core <> '' AND NOT again AND right(core, 1) NOT IN ('.', '!', '?') AS cut FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows GROUP BY conv_id),
inserts(state, letters, price, next, lines) AS (VALUES (0, '', 0, 0, ''), (0, 'I', 2, 2, E'\nuser:'), (0, 'II', 4, 3, E'\nuser:\nassistant:'), (1, '', 0, 1, ''), (1, 'I', 2, 2, E'\nuser:'), (1, 'II', 4, 3, E'\nuser:\nassistant:'),
    (2, '', 0, 2, ''), (2, 'I', 2, 3, E'\nassistant:'), (2, 'II', 4, 2, E'\nassistant:\nuser:'), (3, '', 0, 3, ''), (3, 'I', 2, 2, E'\nuser:'), (3, 'II', 4, 3, E'\nuser:\nassistant:')),
edits(state, initial, letter, price, next) AS (VALUES (0, 's', 'K', 0, 1), (0, 'u', 'K', 0, 2), (1, 'u', 'K', 0, 2), (2, 'a', 'K', 0, 3), (3, 'u', 'K', 0, 2), (0, NULL, 'R', 2, 2), (1, NULL, 'R', 2, 2), (2, NULL, 'R', 2, 3), (3, NULL, 'R', 2, 2),
    (0, NULL, 'D', 3, 0), (1, NULL, 'D', 3, 1), (2, NULL, 'D', 3, 2), (3, NULL, 'D', 3, 3)),
paths(conv_id, i, state, best) AS (SELECT conv_id, 0::BIGINT, 0, {'cost': 0, 'audit': '', 'lines': ''} FROM counts
    UNION ALL SELECT p.conv_id, r.i, e.next, min({'cost': (best.cost + s.price + e.price + CASE WHEN cut AND letter <> 'D' THEN 1 ELSE 0 END)::INT, 'audit': best.audit || s.letters || letter,
        'lines': best.lines || s.lines || CASE letter WHEN 'K' THEN chr(10) || role || ':' || text WHEN 'R' THEN chr(10) || CASE e.next WHEN 2 THEN 'user:' ELSE 'assistant:' END || text ELSE '' END})
    FROM paths p JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1 JOIN inserts s ON s.state = p.state JOIN edits e ON e.state = s.next AND (letter <> 'K' OR e.initial = r.initial) AND (letter = 'D' OR NOT (blank OR dup))
    GROUP BY p.conv_id, r.i, e.next),
ends AS (SELECT c.conv_id, min({'cost': (best.cost + s.price)::INT, 'audit': best.audit || s.letters, 'lines': best.lines || s.lines}) AS best
    FROM paths p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = c.n JOIN inserts s ON s.state = p.state AND s.next IN (0, 3) GROUP BY c.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels")
    return filter_audit(docs, labels, F.col("quality") == 1, F.col("toxic") == 1)


#: The same without masks' sums: every document's first failed filter in every order.
OP12_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
cut AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
fails AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS f
    FROM cut LEFT JOIN known USING (doc_id)),
masks AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT part, filter_order, step::INT AS step, substr(filter_order, step, 1) AS x, n, good, toxic, contains(f, substr(filter_order, step, 1)) AS failing, f,
    regexp_matches(f, '[' || left(filter_order, step - 1) || '_]') AS gone FROM masks, orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (f = x), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND failing), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND failing), 0)::BIGINT AS toxic_lost FROM steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM counted
"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), f"{TOKENIZERS}/word_bpe_49k.json", keep_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media": op1_media, "op2_neardup": op2_neardup, "op3_topk": op3_topk, "op4_urls": op4_urls, "op5_lmscore": op5_lmscore, "op6_bpe": op6_bpe, "op7_pii": op7_pii, "op8_lines": op8_lines, "op9_mixing": op9_mixing, "op10_langid": op10_langid,
        "op11_repair": op11_repair, "op12_filters": op12_filters, "op13_packing": op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3_SQL, "op4_urls": OP4_SQL, "op8_lines": OP8_SQL, "op9_mixing": OP9_SQL, "op11_repair": OP11_SQL, "op12_filters": OP12_SQL}
