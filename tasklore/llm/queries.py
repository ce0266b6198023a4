"""The queries of the subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tasklore.llm import codes, jaccard, langid, mixing, packing, pages, passages, quality, resampling, secrets, sharding, sketches, substrings


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 400 bytes removed, and the bytes that repeated passages of 256 bytes cover, for every document."""
    return substrings.remove_repeats(_docs(spark, sf_dir)).drop("spans")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return pages.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law of bytes."""
    return sharding.shard_by_bytes(_docs(spark, sf_dir))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and network spans of every document."""
    return secrets.scan_secrets(_docs(spark, sf_dir)).drop("masked")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of every document."""
    return mixing.pareto_mix(_docs(spark, sf_dir)).drop("source", "copies")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and verdicts of every document."""
    return quality.quality_rules(_docs(spark, sf_dir)).drop("failed_rules", "n_stop_words", "n_lines")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those not held out."""
    docs = _docs(spark, sf_dir).withColumn("held_out", langid.held_out())
    dicts = langid.dictionaries(docs.where("doc_id is not null and not held_out"))
    return langid.identify(docs, dicts, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and number of links of every document."""
    return jaccard.jaccard_components(_docs(spark, sf_dir), counted=True)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    return sketches.fingerprint_versions(_docs(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return packing.pack_best_fit(_docs(spark, sf_dir))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 20 words that started earlier removed, for every document."""
    return passages.remove_passages(_docs(spark, sf_dir)).drop("spans")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code and exact error of every vector."""
    return codes.product_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document toward the benchmark's features."""
    return resampling.importance_resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_html_extraction, op3_sharding, op4_secret_scans, op5_mixing,
        op6_quality_rules, op7_language_id, op8_ngram_jaccard, op9_fingerprints, op10_best_fit_packing,
        op11_substring_dedup, op12_vector_codes, op13_importance_resampling,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of a list of bytes, by the table of the reflected polynomial.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, crcs[xor(c % 256, x) + 1])), 4294967295)"""



def _codes_sql(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS) -> str:
    """Product codes as one SQL statement: a few steps for each round of the codebooks."""
    steps = [
        """k as (select vec_id, label, embedding from embeddings where embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"""c as (select vec_id, label, (i - 1) // (len(embedding) // {parts}) as part, (i - 1) % (len(embedding) // {parts}) as place, floor({codes.SCALE} * embedding[i]::double)::bigint as x
  from (select *, unnest(range(1, len(embedding) + 1)) as i from k))""",
        f"f as (select vec_id, row_number() over (order by vec_id) - 1 as entry from k order by vec_id limit {entries})",
        "b0 as (select part, entry, place, x as y from c join f using (vec_id))",
    ]
    for r in range(rounds + 1):
        steps += [
            f"d{r} as materialized (select vec_id, part, entry, sum((x - y) * (x - y))::bigint as d from c join b{r} using (part, place) group by all)",
            f"a{r} as materialized (select vec_id, part, arg_min(entry, d * {entries} + entry) as entry, min(d) as d from d{r} group by all)",
        ]
        if r < rounds:
            steps += [
                f"m{r} as (select part, entry, place, floor(sum(x) / count(*))::bigint as y from c join a{r} using (vec_id, part) group by all)",
                f"b{r + 1} as materialized (select part, entry, place, coalesce(m.y, b.y) as y from b{r} b left join m{r} m using (part, entry, place))",
            ]
    steps += [
        f"e as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a{rounds} group by vec_id)",
        "t as (select vec_id, label, code, error from e join k using (vec_id))",
        f"s as (select sha256(string_agg(y::varchar, ',' order by part, entry, place)) as h from b{rounds})",
    ]
    return "with " + ",\n".join(steps) + "\nselect vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from t, s"


ORACLE_SQL = {
    "op1_suffix_array_dedup": f"""
with d as (select doc_id, row_number() over () as doc, hex(encode(coalesce(text, ''))) as hx from documents),
q as (select doc, c, substr(hx, 512 * c + 1, {510 + 2 * substrings.LEAST}) as piece from (select *, unnest(range(0, length(hx) // 512 + 1)) as c from d)),
p as (select *, unnest(range(0, least(256, length(piece) // 2 - {substrings.PASSAGE - 1}))) as k from q),
w as (
  select doc, 256 * c + k as place, hash(substr(piece, 2 * k + 1, {2 * substrings.PASSAGE})) as passage,
         case when 2 * k + {2 * substrings.LEAST} <= length(piece) then hash(substr(piece, 2 * k + 1, {2 * substrings.LEAST})) end as whole
  from p),
r as (
  select doc, place, {substrings.LEAST} as width from w where whole in (select whole from w where whole is not null group by whole having count(*) > 1)
  union all
  select doc, place, {substrings.PASSAGE} from w where passage in (select passage from w group by passage having count(*) > 1)),
g as (select *, coalesce(place > lag(place) over o + width, true) as opens from r window o as (partition by doc, width order by place)),
s as (select *, sum(opens::int) over (partition by doc, width order by place rows unbounded preceding) as run from g),
u as (select doc, width, run, min(place) as start, max(place) + width as stop from s group by doc, width, run),
z as (select *, coalesce(lag(stop) over (partition by doc, width order by start), 0) as before from u),
k as (
  select doc, sum(stop - start) filter (width = {substrings.LEAST}) as n_removed, count(*) filter (width = {substrings.LEAST}) as n_spans,
         max(stop) filter (width = {substrings.LEAST}) as last, sum(stop - start) filter (width = {substrings.PASSAGE}) as n_passage_bytes
  from z group by doc),
h as (
  select doc, string_agg(substr(hx, 2 * before + 1, 2 * (start - before)), '' order by start) as kept
  from z join d using (doc) where width = {substrings.LEAST} group by doc)
select doc_id, (length(hx) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(kept, '') || substr(hx, 2 * coalesce(last, 0) + 1))) as kept_sha256,
       coalesce(n_passage_bytes, 0)::bigint as n_passage_bytes, coalesce(n_passage_bytes, 0) > 0 as has_passage
from d left join k using (doc) left join h using (doc)""",
    "op3_sharding": f"""
with c as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
             lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as crcs),
b as (select doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint) as bytes from documents),
d as (select doc_id, (len(bytes) + 1)::bigint as size, {_CRC32}::bigint as text_crc32 from b, c),
p as (
  select *, sum(size) over (order by doc_id nulls first, text_crc32, size rows unbounded preceding) - size as start, sum(size) over () as total,
         row_number() over (order by doc_id nulls first, text_crc32, size) as place
  from d),
s as (select *, least(((2 * start + size) * 8) // (2 * total), 7)::int as shard from p)
select doc_id, size, text_crc32, 'bytes' as law, shard, place - min(place) over (partition by shard) as slot, null::int as grown_shard
from s""",
    "op8_ngram_jaccard": f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as ws from documents),
g as (
  select distinct doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') as gram
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n_shingles from g group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as both from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
half as (
  select c.a, c.b from common c join n x on c.a = x.doc_id join n y on c.b = y.doc_id
  where 100 * c.both >= 75 * (x.n_shingles + y.n_shingles - c.both)),
link as (select a, b from half union all select b, a from half),
reach as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
k as (select a as doc_id, count(*) as n_links from link group by a),
m as (select a as doc_id, min(b) as low from reach group by a)
select doc_id, coalesce(n_shingles, 0)::bigint as n_shingles, least(doc_id, coalesce(low, doc_id)) as component_id, coalesce(n_links, 0)::bigint as n_links
from d left join n using (doc_id) left join k using (doc_id) left join m using (doc_id)""",
    "op5_mixing": rf"""
with d as (
  select doc_id, source, len({_WORDS})::bigint as size,
         (('0x' || substr(md5(concat_ws('|', 'mix', doc_id, md5(coalesce(text, '')))), 1, 13))::bigint + 0.5) / 4503599627370496.0 as u
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3) + 1] as weight from s),
c as (select *, source_size * 2.0::double as cap, source_size * 2.0::double / weight as ratio from w),
l as (select *, (sum(source_size) over () * 1.5::double
        - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
        / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as own from c),
t as (select source, source_size, least(cap, max(own) over () * weight) as target from l),
k as (select d.*, least(length(bin(size)), 10) + 10 as tenths from d),
g as (select source, tenths, sum(size)::bigint as words from k group by source, tenths),
e as (select g.*, source_size, target,
        (target - coalesce(sum(words) over (partition by g.source order by tenths desc rows between unbounded preceding and 1 preceding), 0) * 2.0::double)
        / nullif(sum(words * tenths) over (partition by g.source order by tenths desc rows between current row and unbounded following), 0) as own
      from g join t on g.source is not distinct from t.source),
f as (select *, round(greatest(least(coalesce(max(own) over (partition by source), 0.0) * tenths, 2.0::double), 0.0), 9) as copies from e),
x as (select *, floor(copies) as whole, copies - floor(copies) as p from f),
r as (select *, target - sum(whole * words) over (partition by source) as wanted from x),
y as (select k.*, r.source_size, r.target, r.whole, r.wanted, r.p, case when p > 0 then u / (1 - u) / (p / (1 - p)) end as rank
      from k join r on k.source is not distinct from r.source and k.tenths = r.tenths),
q as (select *, sum(case when p > 0 then size else 0 end) over (partition by source order by rank nulls last, doc_id, size rows unbounded preceding) - size as start from y)
select doc_id, size, source_size, target,
       (least(whole + case when p > 0 and start + size / 2.0::double <= wanted then 1 else 0 end, 2) * size)::bigint as taken
from q""",
    "op6_quality_rules": rf"""
with d as (
  select doc_id, coalesce(text, '') as body, {_WORDS} as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
g as (select doc_id, i, list_slice(ws, i, i + 4) as gram from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from d)),
r as (select g.doc_id, g.i from g join (select doc_id, gram from g group by doc_id, gram having count(*) > 1) using (doc_id, gram)),
n as (select doc_id, count(distinct i + k) as n_repeat_words from r, (select unnest(range(0, 5)) as k) group by doc_id),
m as (
  select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
         (length(body) - length(translate(body, '{quality.SYMBOLS}', '')))::bigint as n_symbols, len(ls) as n_lines,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         len(list_filter(ws, lambda x: lower(x) in ({", ".join(f"'{w}'" for w in quality.STOP_WORDS)}))) as n_stop_words,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d left join n using (doc_id)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (
         {" or ".join(f"((({r.over} < {r.under} * {r.low}::double) or ({r.over} > {r.under} * {r.high}::double)) and n_words >= {r.least})".replace(f"({r.over} < {r.under} * None::double)", "false").replace(f"({r.over} > {r.under} * None::double)", "false") for r in quality.RULES)}
       ) as kept
from f""",
    "op11_substring_dedup": rf"""
with d as (select doc_id, {_WORDS} as ws from documents),
w as (select doc_id, unnest(range(1, len(ws) - {passages.LEAST - 2})) as i, unnest(list_transform(range(1, len(ws) - {passages.LEAST - 2}), lambda k: hash(list_slice(ws, k, k + {passages.LEAST - 1})))) as h
      from d where len(ws) >= {passages.LEAST}),
f as (select doc_id, i from w qualify row_number() over (partition by h order by doc_id, i) > 1),
g as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + {passages.LEAST}, true) as opens from f),
r as (select doc_id, i, sum(opens::int) over (partition by doc_id order by i rows unbounded preceding) as run from g),
s as (select doc_id, min(i) as start, max(i) + {passages.LEAST} as stop from r group by doc_id, run),
z as (select *, coalesce(lag(stop) over (partition by doc_id order by start), 1) as before from s),
k as (select doc_id, sum(stop - start) as n_removed, max(stop) as last, flatten(list(list_slice(ws, before, start - 1) order by start)) as kept from z join d using (doc_id) group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(array_to_string(list_concat(coalesce(kept, []), list_slice(ws, coalesce(last, 1), len(ws))), ' ')) as kept_sha256
from d left join k using (doc_id)""",
    "op12_vector_codes": _codes_sql(),
    "op13_importance_resampling": rf"""
with tab as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
             lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as crcs),
d as (select doc_id, 0 as side, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
      union all select null, 1, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
n as (select row_number() over () as doc, * from d),
g as (select doc, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
             list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) as gram from n),
u as (select gram, list_transform(regexp_extract_all(hex(encode(gram)), '..'), lambda x: ('0x' || x)::bigint) as bytes from (select distinct gram from g)),
c as (select gram, ({_CRC32} % {resampling.BUCKETS})::int as bucket from u, tab),
o as (select doc, side, bucket, count(*) as n from g join c using (gram) join n using (doc) group by all),
b as (select bucket, sum(case when side = 0 then n else 0 end) as s, sum(case when side = 1 then n else 0 end) as t from o group by bucket),
z as (select sum(s) as ss, sum(t) as tt from b),
gain as (select bucket, floor(1000 * ln((t + 1)::double * (ss + {resampling.BUCKETS}) / ((s + 1)::double * (tt + {resampling.BUCKETS}))))::bigint as gain from b, z),
w as (select doc, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from o join gain using (bucket) where side = 0 group by doc),
k as (select doc_id, len(ws) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, ('0x' || substr(sha256('42:' || doc_id), 1, 8))::bigint as h
      from n left join w using (doc) where side = 0),
x as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint as score from k),
r as (select *, row_number() over (order by n_words >= {resampling.LEAST_WORDS} desc, score desc, doc_id) as place, count(*) filter (where n_words >= {resampling.LEAST_WORDS}) over () as total from x)
select doc_id, n_words::bigint as n_words, n_features, weight, score, case when n_words >= {resampling.LEAST_WORDS} and place <= {resampling.SHARE} * total // 100 then place end as rank from r""",
}
