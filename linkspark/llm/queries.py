"""The operators' queries with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import chat, decontam, fingerprints, linededup, linefrequency, manifest, mixing, neardup, packing, resampling, secrets, sharding, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.dedup_lines(table(spark, sf_dir, "documents")))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_turns(chat.with_probe(table(spark, sf_dir, "conversations"), spark)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows follow the order in which the input is split among tasks: another split packs the same tokens in other rows."""
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "window_start")


def op10_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linefrequency.quality(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(table(spark, sf_dir, "documents"), changed=manifest.tampered())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_document_fingerprints, op3_line_dedup, op4_chat_formatting, op5_toxicity, op6_source_mixing, op7_token_packing, op8_sharding, op9_benchmark_decontamination, op10_simhash_neardup, op11_importance_resampling, op12_line_frequency, op13_merkle_manifest, pipeline)
}

_CONTROL = "(\\\\*)(<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>|<\\|endoftext\\|>|<\\|im_start\\|>|<\\|im_end\\|>)"

#: CRC-32 of every text x of table ``texts``, as table crc (x, c): the register is linear in the bytes, so each byte's share follows
#: from its value and its distance from the end.
_CRC = """
bits as (select b, 0 as k, b::bigint as c from range(256) r(b) union all select b, k + 1, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end from bits where k < 8),
first as (select b, c from bits where k = 8),
longest as (select coalesce(max(octet_length(encode(x))), 0) as n from texts),
place as (select b, 0 as k, c from first union all select p.b, p.k + 1, xor(p.c >> 8, t.c) from place p join first t on t.b = (p.c & 255) where p.k + 1 < (select n from longest)),
empty as (select 0 as n, 4294967295::bigint as c union all select e.n + 1, xor(e.c >> 8, t.c) from empty e join first t on t.b = (e.c & 255) where e.n < (select n from longest)),
bytes as (select x, octet_length(encode(x)) as n, unnest(range(octet_length(encode(x)))) as i from texts),
shares as (select x, n, n - 1 - i as k, ('0x' || substr(hex(encode(x)), (2 * i + 1)::int, 2))::int as b from bytes),
crc as (select s.x, xor(xor(bit_xor(p.c), any_value(e.c)), 4294967295) as c from shares s join place p using (b, k) join empty e on e.n = s.n group by s.x)
"""

ORACLES: dict[str, str] = {
    "op11_importance_resampling": r"""
with recursive w as (
  select 0 as kind, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
), each as (select kind, id, unnest(w) as x, generate_subscripts(w, 1) as i from w), runs as (
  select kind, id, x, x || ' ' || lead(x) over near as y, x || ' ' || lead(x) over near || ' ' || lead(x, 2) over near as z from each window near as (partition by kind, id order by i)
), f as (select kind, id, unnest([x, y, z]) as x from runs), texts as (select distinct x from f where x is not null),"""
    + _CRC
    + r""", b as (select kind, id, c % 10000 as bucket from f join crc using (x)),
n as (select bucket, count(*) filter (where kind = 0) as s, count(*) filter (where kind = 1) as t from b group by bucket),
gains as (select bucket, cast(floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000) / ((s + 1)::double * (sum(t) over () + 10000)))) as bigint) as gain from n),
sums as (select id, count(*) as n_features, sum(gain)::bigint as weight from b join gains using (bucket) where kind = 0 group by id),
scored as (
  select w.id as doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('42:' || w.id), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from w left join sums using (id) where kind = 0
), ranked as (select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_words >= 20)
select doc_id, n_features::bigint as n_features, weight, score, case when rank <= (5 * (select count(*) from ranked)) // 100 then rank end as rank from scored left join ranked using (doc_id)
""",
    "op12_line_frequency": r"""
with d as (
  select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, string_split(coalesce(text, ''), chr(10)) as l from documents
), each as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from d), grams as (
  select doc_id, i, x || ' ' || lead(x, 1) over near || ' ' || lead(x, 2) over near || ' ' || lead(x, 3) over near || ' ' || lead(x, 4) over near || ' ' || lead(x, 5) over near || ' ' || lead(x, 6) over near || ' ' || lead(x, 7) over near as x from each window near as (partition by doc_id order by i)
), again as (select doc_id, x from grams where x is not null group by doc_id, x having count(*) > 1),
covered as (select doc_id, count(distinct i + k) as n from grams join again using (doc_id, x), range(8) r(k) group by doc_id),
dup as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(l) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
lines as (select doc_id, source, text, trim(regexp_replace(regexp_replace(lower(unnest(l)), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) as line from d),
hosts as (select source, count(distinct text) as n from d group by source),
common as (select f.source, f.line from (select source, line, count(distinct text) as n from lines where line <> '' group by source, line) f join hosts h on f.source is not distinct from h.source where f.n > greatest(20, floor(h.n * 0.005::double))),
gone as (select doc_id, sum(len(string_split(l.line, ' ')))::bigint as n from lines l join common c on l.source is not distinct from c.source and l.line = c.line group by doc_id),
m as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
    coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words, coalesce(gone.n, 0) as removed_words
  from d left join dup using (doc_id) left join covered using (doc_id) left join gone using (doc_id)
), j as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select *, not base_failed and n_words - removed_words >= 20 and n_words - removed_words >= 0.3::double * n_words as kept from j
""",
    "op13_merkle_manifest": r"""
with recursive texts as (select distinct cast(doc_id as varchar) as x from documents where doc_id is not null),"""
    + _CRC
    + r""", d as (
  select doc_id, lang, c % 7 = 0 as hit, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
    n_chars, coalesce(strlen(text) || ':' || text, '-') as tail from documents left join crc on x = cast(doc_id as varchar)
), rows as (
  select doc_id, lang, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
    sha256(head || coalesce(strlen((n_chars + coalesce(hit, false)::int)::varchar) || ':' || (n_chars + coalesce(hit, false)::int), '-') || tail) as claimed from d
), leaves as (
  select *, 0 as tree, coalesce('=' || lang, '') as g, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from rows
), nodes as (
  select g, 0 as level, i, n, leaf as digest from leaves
  union all
  select g, level + 1, i // 2, n, sha256(digest || coalesce(next, '')) from (select *, lead(digest) over (partition by g, level order by i) as next from nodes) where i % 2 = 0 and (n - 1) >> level > 0
), subroots as (select g, digest as subroot from nodes where (n - 1) >> level = 0),
tops as (
  select 0 as level, row_number() over (order by g) - 1 as i, count(*) over () as n, subroot as digest, g from subroots
  union all
  select level + 1, i // 2, n, sha256(digest || coalesce(next, '')), null from (select *, lead(digest) over (partition by level order by i) as next from tops) where i % 2 = 0 and (n - 1) >> level > 0
), climb as (
  select doc_id, g, leaf, i as at, i, n, 0 as level, claimed as state, '' as proof from leaves
  union all
  select c.doc_id, c.g, c.leaf, c.at, c.i // 2, c.n, c.level + 1, sha256(case when c.i % 2 = 1 then s.digest || c.state else c.state || coalesce(s.digest, '') end), c.proof || coalesce(s.digest, '')
  from climb c left join nodes s on s.g = c.g and s.level = c.level and s.i = xor(c.i, 1) where (c.n - 1) >> c.level > 0
), over as (
  select c.doc_id, c.g, c.leaf, c.at, t.i, t.n, 0 as level, c.state, c.proof from climb c join tops t on t.g = c.g and t.level = 0 where (c.n - 1) >> c.level = 0
  union all
  select c.doc_id, c.g, c.leaf, c.at, c.i // 2, c.n, c.level + 1, sha256(case when c.i % 2 = 1 then s.digest || c.state else c.state || coalesce(s.digest, '') end), c.proof || coalesce(s.digest, '')
  from over c left join tops s on s.level = c.level and s.i = xor(c.i, 1) where (c.n - 1) >> c.level > 0
)
select doc_id, leaf, subroot, digest as root, sha256(proof) as proof_sha256, state as folded_root, state = digest as verified
from over o join subroots using (g), tops t where (o.n - 1) >> o.level = 0 and (t.n - 1) >> t.level = 0
""",
    "op4_chat_formatting": rf"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(length('<s>[INST] ') + length(' [/INST]' || chr(10)) + length(chr(10) || '</s>')
    + length(regexp_replace(role, '{_CONTROL}', '\\\1\2', 'g')) + length(regexp_replace(text, '{_CONTROL}', '\\\1\2', 'g'))) as bigint) as formatted_chars
from rows group by conv_id
""",
    "op6_source_mixing": r"""
with base as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    (cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'text:' || coalesce(text, ''))), 1, 13) as bigint) + 0.5::double) / 4503599627370496::double as u,
    case when length(text) > 0 then greatest(0.05::double, round(1 - 4 * (length(text) - length(translate(text, '#$%&*!|', '')))::double / length(text), 3)) else 0.05::double end as quality
  from documents
), keyed as (select *, greatest(round(-ln(u) / quality, 9), 1e-9::double) as key from base),
sizes as (
  select source, sum(size)::bigint as source_size,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3::double when 1 then 1::double else 2::double end as weight
  from keyed group by source
), levels as (
  select *, (1.5 * sum(source_size) over () - coalesce(sum(2.0::double * source_size) over (order by 2.0::double * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by 2.0::double * source_size / weight, source nulls last rows between current row and unbounded following) as level
  from sizes
), targets as (
  select source, source_size, least(2.0::double * source_size, weight * (select max(level) from levels)) as target from levels
), placed as (
  select k.*, t.source_size, t.target, cast(round(t.target) as bigint) as goal,
    coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows between unbounded preceding and 1 preceding), 0) as before
  from keyed k join targets t on k.source is not distinct from t.source
)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(case when source_size > 0 then (goal // source_size) * size + least(greatest(goal - (goal // source_size) * source_size - before, 0), size) else 0 end as bigint) as taken
from placed
""",
    "op9_benchmark_decontamination": r"""
with w as (
  select 0 as kind, doc_id as id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents
  union all
  select 1, item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') from benchmark
), s as (
  select kind, id, case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as h from w
), p as (select kind, id, len(h) as n, unnest(h) as x, generate_subscripts(h, 1) - 1 as pos from s),
starts as (
  select distinct doc_id, item_id, m, unnest(range(greatest(0, pos - least(m, n) + 1), least(pos, greatest(n - m, 0)) + 1)) as "start"
  from (select d.id as doc_id, i.id as item_id, i.n as m, d.n as n, d.pos as pos from p d join p i on d.kind = 0 and i.kind = 1 and d.x = i.x)
), counts as (
  select t.doc_id, t.item_id, t."start", d.x, count(*) as c from starts t join p d on d.kind = 0 and d.id = t.doc_id and d.pos >= t."start" and d.pos < t."start" + t.m group by all
), own as (select id as item_id, x, count(*) as c, any_value(n) as m from p where kind = 1 group by id, x),
shared as (
  select c.doc_id, c.item_id, c."start", any_value(o.m) as m, sum(least(c.c, o.c)) as s from counts c join own o on o.item_id = c.item_id and o.x = c.x group by all
), held as (select doc_id, item_id, "start", sum(c) as n from counts group by all),
scored as (select s.doc_id, s.item_id, s."start", s.s::double / (s.m + h.n - s.s) as similarity from shared s join held h using (doc_id, item_id, "start"))
select doc_id, item_id, round(max(similarity), 6) as similarity, cast(arg_max("start", (similarity, -"start")) as integer) as window_start
from scored where similarity >= 0.8 group by doc_id, item_id
""",
}
