"""The corpus operators applied to whole tables with production parameters, and SQL twins where SQL can say it."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitplanes import read_token_file, write_token_file
from .common import WORD, body, read, table_path, written
from .conversations import repair_conversations
from .exact_dedup import exact_dedup
from .html_crf import extract_main
from .mixing import mix_sources
from .ngram_join import ngram_components
from .packing import pack_documents
from .runs import periodic_runs
from .secrets import scan_secrets
from .topk import top_k
from .toxicity import fit_toxicity, score_toxicity
from .url_filter import url_filter
from .warc import read_archive, with_originals, with_revisits, write_archive


def op1_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "token-file")
    write_token_file(read(spark, sf_dir, "documents"), path)
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(read(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


def op8_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, places = pack_documents(read(spark, sf_dir, "documents"))
    rows = pieces.select("key", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return rows.join(places, "key").drop("key")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"))


def op10_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "model")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    doubted = F.size(F.filter(base, lambda s: ~s["sure"])).cast("long").alias("n_doubted")
    return found.select(
        "doc_id", *map(count, ("assign", "access", "hex", "model")), doubted, F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans")
    )


def _with_planted_repeats(docs: DataFrame) -> DataFrame:
    """The damage of the contract: every tenth document, by the checksum of its id, ends in a repeated stretch."""
    h, words = F.crc32(F.col("doc_id").cast("string")), F.regexp_extract_all(body(), F.lit(WORD), F.lit(0))
    hit = F.coalesce(h % 10 == 0, F.lit(False))
    told = docs.select("doc_id", body().alias("text"), F.when(hit, words).alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w").cast("bigint"))
    told = told.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    told = told.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    places = F.expr("transform(sequence(0L, n - 1), i -> w[int(if(i < a, i, a + (i - a) % p))])")
    return told.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(places, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_with_planted_repeats(read(spark, sf_dir, "documents")), least_words=24, least_exponent=3)
    longer = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    found = found.withColumn("best", F.aggregate("runs", none, lambda best, r: F.when(longer(best, r), r).otherwise(best)))
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _damaged(rows: DataFrame) -> DataFrame:
    """The damage of the contract, by the checksum of conversation and turn."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    told = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("hit")).where("hit <> 0")
    told = told.withColumn("text", F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    told = told.withColumn("role", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")))
    return told.withColumn("copy", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("hit", "copy")


def _conversation_hashes(turns: DataFrame) -> DataFrame:
    """key, sha256 of the lines of each conversation, which pass through one task in order, one at a time."""

    def run(batches):
        key, sha = None, None
        for batch in batches:
            done = []
            for k, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != key:
                    if sha is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(line.as_py().encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in done], pa.string()), "repaired_sha256": pa.array([s for _, s in done], pa.string())})
        if sha is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "repaired_sha256": [sha.hexdigest()]})

    lines = turns.select(_conversation().alias("key"), F.concat_ws(":", "role", "text").alias("line"), "place").repartition("key").sortWithinPartitions("key", "place")
    return lines.select("key", "line").mapInArrow(run, "key string, repaired_sha256 string")


def _conversation():
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    summary, repaired = repair_conversations(_damaged(rows))
    every = rows.select("conv_id").distinct().withColumn("key", _conversation())
    found = every.join(summary.withColumn("key", _conversation()).drop("conv_id"), "key", "left").join(_conversation_hashes(repaired), "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "archive")
    write_archive(with_revisits(read(spark, sf_dir, "pages"), key="page_id", uri="url", payload="html"), path)
    heads = written(read_archive(spark, path, payloads=False), "archive-heads")
    return with_originals(heads).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").alias("refers_to"))


def queries() -> dict:
    found = (op1_bitplane_tokens, op2_html_crf, op3_exact_dedup, op4_ngram_join, op5_top_k, op6_toxicity, op7_mix_sources, op8_pack_documents, op9_url_filter, op10_scan_secrets, op11_periodic_runs, op12_repair_conversations, op13_warc_revisits)
    return {f.__name__: f for f in found}


OP3_SQL = """
with d as (select doc_id, coalesce(text, '') body, row_number() over (partition by doc_id, coalesce(text, '')) nth from documents),
g as (select body, max(doc_id) keep_id, count(*) group_size from d group by body)
select doc_id, keep_id, group_size, (doc_id is not distinct from keep_id) and nth = 1 as kept, sha256(body) text_sha256
from d join g using (body)
"""

OP7_SQL = r"""
with recursive d as (
  select doc_id, source, md5('mix:' || coalesce(cast(doc_id as varchar), 'null')) k,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size from documents),
s as (select source, cast(sum(size) as bigint) source_size, row_number() over (order by source is null, encode(source)) nth from d group by source),
w as (select source, source_size, [3, 1, 2][1 + (nth - 1) % 3] weight, 2.0 * cast(source_size as double) cap, encode(source) code from s),
r as (select *, row_number() over (order by cap / weight, source is null, code) place,
             1.5 * cast(sum(source_size) over () as double) total, sum(weight) over () all_weights,
             coalesce(sum(cap) over (order by cap / weight, source is null, code rows between unbounded preceding and 1 preceding), 0) capped,
             coalesce(sum(weight) over (order by cap / weight, source is null, code rows between unbounded preceding and 1 preceding), 0) gone from w),
l as (select *, (total - capped) / cast(all_weights - gone as double) level from r),
f as (select level from l where cap >= level * weight order by place limit 1),
t as (select l.source, l.source_size, case when f.level is null or l.place < (select min(place) from l where cap >= level * weight) then l.cap
             else least(f.level * l.weight, l.cap) end target from l left join f on true),
b as (select *, cast(floor(target) as bigint) budget from t),
e as (select *, case when source_size > 0 then budget // source_size else 0 end epochs from b),
p as (select d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size rest,
             coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) ahead
      from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, rest - ahead)) as bigint) taken from p
"""

OP9_SQL = r"""
with u as (
  select page_id, regexp_replace(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '', '') raw,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path from pages),
h as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, path from u),
rules(nth, verdict, rule_host, prefix) as (values (0, 'allow', 'com', '/'), (1, 'block', 'example.com', '/en/'),
  (2, 'allow', 'www.example.com', '/en/'), (3, 'block', 'net', '/es/'), (4, 'block', 'net', '/fr/')),
m as (select page_id, host, path, rule_host || prefix as rule, verdict,
             row_number() over (partition by page_id, host, path order by length(rule_host || prefix) desc nulls last, nth) place
      from h left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, prefix)),
r as (select * exclude (place),
             array_to_string(list_transform(string_split(path, '/'), lambda s: case when regexp_matches(s, '[0-9]|^[a-fA-F-]{16,}$')
               then '*' || regexp_extract(s, '(\.[A-Za-z]{1,5})$', 1) else s end), '/') shape from m where place = 1),
c as (select host, shape, count(*) n, count(rule) n_labelled, count(*) filter (verdict = 'block') n_block, string_split(shape, '/')[2:] parts
      from r group by host, shape),
n1 as (select host, count(distinct parts[1]) children, sum(n) below from c where len(parts) >= 1 group by host),
t1 as (select c.*, case when children >= 8 and children >= 0.5 * below and parts[1] <> '' then '*' else parts[1] end s1 from c left join n1 using (host)),
n2 as (select host, s1, count(distinct parts[2]) children, sum(n) below from t1 where len(parts) >= 2 group by host, s1),
t2 as (select t1.*, case when n2.children >= 8 and n2.children >= 0.5 * n2.below and parts[2] <> '' then '*' else parts[2] end s2
       from t1 left join n2 on t1.host = n2.host and t1.s1 = n2.s1),
n3 as (select host, s1, s2, count(distinct parts[3]) children, sum(n) below from t2 where len(parts) >= 3 group by host, s1, s2),
t3 as (select t2.*, case when n3.children >= 8 and n3.children >= 0.5 * n3.below and parts[3] <> '' then '*' else parts[3] end s3
       from t2 left join n3 on t2.host = n3.host and t2.s1 = n3.s1 and t2.s2 = n3.s2),
t4 as (select host, shape, n_labelled, n_block, coalesce('/' || s1, '') b1, b1 || coalesce('/' || s2, '') b2, b2 || coalesce('/' || s3, '') b3,
              b3 || repeat('/*', greatest(len(parts) - 3, 0)) as template from t3),
k as (select *, least(coalesce(cast(sum(n_block) over () as double) / nullif(sum(n_labelled) over (), 0), 0), 0.5) prior,
             cast(sum(n_block) over (partition by host, template) as double) kt, cast(sum(n_labelled) over (partition by host, template) as double) nt,
             cast(sum(n_block) over (partition by host, b3) as double) k3, cast(sum(n_labelled) over (partition by host, b3) as double) n3,
             cast(sum(n_block) over (partition by host, b2) as double) k2, cast(sum(n_labelled) over (partition by host, b2) as double) n2,
             cast(sum(n_block) over (partition by host, b1) as double) k1, cast(sum(n_labelled) over (partition by host, b1) as double) n1,
             cast(sum(n_block) over (partition by host) as double) kh, cast(sum(n_labelled) over (partition by host) as double) nh from t4),
a as (select *, case when n1 = 0 then true else abs(k1 / n1 - kh / nh) <= 1.96 * sqrt(kh / nh * (1 - kh / nh) * (1 / n1 + 1 / nh)) end a1,
             case when n2 = 0 then true else abs(k2 / n2 - k1 / n1) <= 1.96 * sqrt(k1 / n1 * (1 - k1 / n1) * (1 / n2 + 1 / n1)) end a2,
             case when n3 = 0 then true else abs(k3 / n3 - k2 / n2) <= 1.96 * sqrt(k2 / n2 * (1 - k2 / n2) * (1 / n3 + 1 / n2)) end a3 from k),
e as (select *, case when a1 then cast(sum(n_block) over (partition by host, a1) as double) else k1 end ke1,
             case when a1 then cast(sum(n_labelled) over (partition by host, a1) as double) else n1 end ne1,
             case when a2 then cast(sum(n_block) over (partition by host, b1, a2) as double) else k2 end ke2,
             case when a2 then cast(sum(n_labelled) over (partition by host, b1, a2) as double) else n2 end ne2,
             case when a3 then cast(sum(n_block) over (partition by host, b2, a3) as double) else k3 end ke3,
             case when a3 then cast(sum(n_labelled) over (partition by host, b2, a3) as double) else n3 end ne3 from a),
q1 as (select *, (ke1 + 8 * ((kh + 8 * prior) / (nh + 8))) / (ne1 + 8) p1 from e),
q2 as (select *, (ke2 + 8 * p1) / (ne2 + 8) p2 from q1),
q3 as (select *, (ke3 + 8 * p2) / (ne3 + 8) p3 from q2),
p as (select host, shape, template, (kt + 8 * p3) / (nt + 8) purity from q3)
select page_id, host, path, rule, coalesce(verdict, case when purity >= 0.75 then 'block' else 'allow' end) verdict, template, purity
from r left join p using (host, shape)
"""


OP5_SQL = """
with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) v from embeddings
           where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select vec_id, len(v) dims, min(v) v from e where vec_id % 20 = 0 group by vec_id, len(v)),
p as (select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) score from a q join e c on q.vec_id <> c.vec_id
      where q.dims = len(c.v))
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 20
"""


OP13_SQL = """
with p as (select page_id, coalesce(html, '') html from pages),
d as (select page_id, cast(octet_length(encode(html)) as bigint) payload_bytes, sha256(html) payload_digest from p),
g as (select *, min(page_id) over (partition by payload_digest) first_id, row_number() over (partition by payload_digest order by page_id nulls last) nth from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and nth > 1 then 'revisit' else 'response' end record_type,
       case when payload_bytes >= 100 and nth > 1 then first_id end refers_to from g
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op5_top_k": OP5_SQL, "op7_mix_sources": OP7_SQL, "op9_url_filter": OP9_SQL, "op13_warc_revisits": OP13_SQL}
