"""The registered queries of the training-data operators and, where SQL can express one, its DuckDB SQL.

Each query reads its whole table and derives the columns that are compared from its operator's output.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenekiln.llm import sharding
from scenekiln.llm.bpe import BpeOperator
from scenekiln.llm.chat import Template, digest_chats, format_chats
from scenekiln.llm.decontam import decontaminate
from scenekiln.llm.filter_audit import audit
from scenekiln.llm.langid import held_out, identify, learn
from scenekiln.llm.license_scan import BASE, LOWER, NOTICES, THRESHOLD, UPPER, WORD, scan
from scenekiln.llm.minhash import NearDuplicates
from scenekiln.llm.mixing import Mix
from scenekiln.llm.mtree import top_products
from scenekiln.llm.url_filter import Rule, filter_urls
from scenekiln.llm.vector_codes import compress, with_label_error
from scenekiln.llm.vptree import nearest_neighbours
from scenekiln.session import shared_dir, table

#: The url rules that op2 judges by.
URL_RULES = [Rule.parse(line) for line in ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _op1_sql() -> str:
    stride = max(len(t.words) for t in BASE + NOTICES)
    rows = ", ".join(f"('{t.label}', {sorted(set(t.words))}, {t.words}, {t.needed(THRESHOLD)}, {t.exact})" for t in BASE + NOTICES)
    return rf"""
WITH templates(label, own, phrase, needed, exact) AS (VALUES {rows}),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
blocks AS (SELECT doc_id, list_distinct(w[k*{stride}+1:k*{stride}+{2 * stride}]) AS b FROM (SELECT doc_id, w, unnest(range(0, (len(w) + {stride - 1}) // {stride})) AS k FROM docs)),
met AS (SELECT doc_id, label, exact, len(list_intersect(b, own)) / len(own)::DOUBLE AS share FROM blocks, templates WHERE len(list_intersect(b, own)) >= needed),
places AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM docs), templates WHERE exact AND w[i+1] = phrase[1] AND w[i+1:i+len(phrase)] = phrase),
base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM places GROUP BY 1),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM (SELECT doc_id, label FROM met WHERE NOT exact UNION SELECT doc_id, label FROM places) GROUP BY 1),
top AS (SELECT doc_id, max(share) AS share FROM met GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
  coalesce(base.l, '') AS base_labels, coalesce(named.l, '') AS labels, coalesce(share, 0.0) AS score
FROM docs d LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN top USING (doc_id)
"""


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url; urls that no rule fits are allowed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}),
fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes, by the stored slot map after one rebalancing."""
    records = sharding.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
    folder = f"{shared_dir(spark).rstrip('/')}/shard-map-{uuid.uuid4().hex}"
    sharding.SlotMap.initial(8).save(spark, folder)
    sharding.SlotMap.load(spark, folder, 1).rebalance(sharding.slot_bytes(records)).save(spark, folder)
    slot_map = sharding.SlotMap.load(spark, folder, 2)
    placed = sharding.positions(records, slot_map)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document, and how many output shards and slots they are dealt to."""
    taken = Mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).taken()
    return taken.select("doc_id", "size", "source_size", "target", "taken", "first_shard", "slots")


def op4_mixing_dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that fill every slot of every output shard of the same mix."""
    return Mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).dealt()


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest by cosine of every vector whose id is divisible by 50, as the relaxed search finds them."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five largest integer inner products of every vector whose id is divisible by 50."""
    return top_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)


OP6_SQL = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM clean q JOIN clean c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


#: The conversation that op7 adds to the table.
ADDED_CHAT = r"\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED_CHAT).alias("text")
    )
    return digest_chats(format_chats(chats.unionByName(added)))


def _op7_sql() -> str:
    t = Template()
    escaped = f"replace(text, '{t.escape}', '{t.escape * 2}')"
    for control in t.controls:
        escaped = f"replace({escaped}, '{control}', '{t.escape}{control}')"
    heads = " ".join(f"WHEN '{role}' THEN {len(head)}" for role, head in t.headers.items())
    named = f"replace(role, '{t.escape}', '{t.escape * 2}')"
    for control in t.controls:
        named = f"replace({named}, '{control}', '{t.escape}{control}')"
    named = f"replace({named}, '{t.close}', '{t.escape}{t.close}')"
    allowed = " OR ".join(f"(before = '{a}' AND role IN ({', '.join(repr(b) for b in sorted(bs))}))" for a, bs in t.follows.items())
    return f"""
WITH chats AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{ADDED_CHAT}' UNION ALL SELECT -7, 1, 'assistant', '{ADDED_CHAT}'),
steps AS (SELECT *, coalesce(lag(role) OVER w, '') AS before, lead(role) OVER w IS NULL AS last FROM chats WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE role {heads} ELSE {len(t.other + t.close)} + length({named}) END + length({escaped}) + {len(t.end)})::BIGINT AS formatted_chars,
  bool_and(({allowed}) AND (NOT last OR role IN ({', '.join(repr(r) for r in sorted(t.final))}))) AS valid
FROM steps GROUP BY conv_id
"""


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.select("doc_id", "text", "lang"), ~held_out())
    out = identify(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on shingles of four words."""
    return NearDuplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=80).result()


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
linked AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, v FROM reach JOIN linked ON u = r)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r) AS component_id, s.doc_id = min(r) AS kept
FROM sets s JOIN reach USING (doc_id) GROUP BY s.doc_id, s.s
"""


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    bpe = BpeOperator(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", bpe.digest(bpe.ids("text")).alias("d")).select("doc_id", "d.*")


def op11_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a phrase of the benchmark, and the items whose phrases occur."""
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT r, i, grams.size, item_id FROM grams JOIN windows ON grams.size = windows.size AND grams.g = windows.g),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS place FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from each part, at each step of each order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")).filter("part IS NOT NULL")


OP12_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY t), false)] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words LEFT JOIN marks ON words.doc_id = marks.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest(range(1, 6)) AS n),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o, [a.n, b.n, c.n, d.n, e.n] AS f FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.n, b.n, c.n, d.n, e.n])) = 5),
kinds AS (SELECT part, fails, good, toxic, count(*) AS n FROM judged GROUP BY ALL),
runs AS (SELECT part, o, f, fails, good, toxic, n, coalesce(list_position([fails[x] FOR x IN f], true), 6) AS gone FROM kinds, orders),
counted AS (
  SELECT part, o AS filter_order, step::INTEGER AS step, f[step] AS filter, sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails[f[step]] AND gone < step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails[f[step]] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone = step AND good = 1 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM runs, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, o, step, f[step])
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counted
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, by the codebooks after four rounds."""
    codes, _ = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _op13_sql(rounds: int = 4) -> str:
    far = lambda c: f"list_inner_product({c}, {c}) - 2 * list_inner_product({c}, p.v)"
    rounds_sql = "".join(
        f"""near{k} AS (SELECT p.vec_id, p.part, arg_min(e.entry, ({far('e.v')}, e.entry)) AS entry FROM parts p JOIN book{k} e ON p.part = e.part GROUP BY p.vec_id, p.part),
mean{k} AS (
  SELECT part, entry, list(m ORDER BY i) AS v FROM (
    SELECT part, entry, i, floor(sum(x)::DOUBLE / count(*)) AS m
    FROM (SELECT n.part, n.entry, unnest(p.v) AS x, unnest(range(0, len(p.v))) AS i FROM near{k} n JOIN parts p ON n.vec_id = p.vec_id AND n.part = p.part) GROUP BY part, entry, i) GROUP BY part, entry),
book{k + 1} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON b.part = m.part AND b.entry = m.entry),
"""
        for k in range(rounds)
    )
    return f"""
WITH clean AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS v FROM clean, (SELECT unnest(range(0, 4)) AS part)),
book0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts WHERE vec_id IN (SELECT vec_id FROM clean ORDER BY vec_id LIMIT 256)),
{rounds_sql}last AS (
  SELECT p.vec_id, p.label, p.part, arg_min(e.entry, ({far('e.v')}, e.entry)) AS entry, min({far('e.v')}) + any_value(list_inner_product(p.v, p.v)) AS d
  FROM parts p JOIN book{rounds} e ON p.part = e.part GROUP BY p.vec_id, p.label, p.part),
codes AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM last GROUP BY vec_id, label),
sha AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS s FROM (SELECT part, entry, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM book{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM codes, sha
"""


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_url_filter": op2_url_filter,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op4_mixing_dealt": op4_mixing_dealt,
    "op5_ann": op5_ann,
    "op6_topk": op6_topk,
    "op7_chat": op7_chat,
    "op8_langid": op8_langid,
    "op9_minhash": op9_minhash,
    "op10_bpe": op10_bpe,
    "op11_decontam": op11_decontam,
    "op12_filter_audit": op12_filter_audit,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": _op1_sql(),
    "op2_url_filter": OP2_SQL,
    "op6_topk": OP6_SQL,
    "op7_chat": _op7_sql(),
    "op9_minhash": OP9_SQL,
    "op11_decontam": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_vector_codes": _op13_sql(),
}
