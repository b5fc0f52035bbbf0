"""The registered queries, each applying one operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abundix.llm import simple8b, warc_zstd
from abundix.llm.anchors import repeats
from abundix.llm.class_lm import score_documents
from abundix.llm.collocations import collocations
from abundix.llm.hilbert import hilbert_shards
from abundix.llm.host_rules import quality_rules
from abundix.llm.jaccard_rtree import jaccard_components
from abundix.llm.line_dedup import deduplicated
from abundix.llm.lloyd import vector_codes
from abundix.llm.mixing import Mix, cycled_weights, with_word_counts
from abundix.llm.perspectives import rotate
from abundix.llm.registry import ORACLES, QUERIES, query, table
from abundix.llm.spaced_seeds import contaminated

@query("op1_mix_sources")
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    mix = Mix(with_word_counts(docs, "text", "size"), cycled_weights)
    places = F.transform("places", lambda p: F.concat_ws("-", *[p[c].cast("string") for c in ("shard", "slot", "first_word", "n_words")]))
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken", "source", F.array_join(places, " ").alias("places"))


@query("op3_hilbert_shards")
def shard_documents(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, folder, "documents").select(
        "doc_id",
        "source",
        "lang",
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = hilbert_shards(docs, ["source", "lang", "size"], 16, ties=["doc_id", "text_crc32"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


HOST_RULES_SQL = r"""
with texts as (
  select doc_id, source, coalesce(text, '') as t from documents
), split as (
  select doc_id, source, t,
    list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') as words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) as lines
  from texts
), starts as (
  select doc_id, unnest(range(1, len(words) - 6)) as i, words from split where len(words) >= 8
), grams as (
  select doc_id, i, count(*) over (partition by doc_id, words[i:i + 7]) as n from starts
), covered as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest(range(i, i + 8)) as p from grams where n >= 2) group by doc_id
), measured as (
  select s.doc_id, s.source, len(words)::bigint as n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from split s left join covered c on s.doc_id = c.doc_id
), marked as (
  select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
    (n_words < 20)::int + (100 * n_repeat_words > 30 * n_words)::int + (10 * n_symbols > n_words)::int
    + (word_chars < 2 * n_words or word_chars > 12 * n_words)::int + (10 * n_dup_lines > 3 * n_lines)::int as failures,
    4 * n_symbols > n_words or 2 * word_chars < 3 * n_words or word_chars > 20 * n_words as clearly
  from measured
), hosts as (
  select source, count(*)::double as docs, sum((failures > 0)::int)::double as failed from marked group by source
), sums as (
  select count(*)::double as h, sum(docs) as d, sum(failed) as f, sum(failed * failed / docs) as q from hosts
), moments as (
  select f / d as m, f / d * (1 - f / d) as b, q / d - (f / d) * (f / d) - f / d * (1 - f / d) * h / d as v from sums
), prior as (
  select m, case when v <= 0 or b = 0 then 1e6 else least(1e6, greatest(1, b / v - 1)) end as w from moments
), rates as (
  select source, (failed + m * w) / (docs + w) as rate, m + sqrt(m * (1 - m) / (w + 1)) as bar from hosts, prior
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and (failures = 0 or (failures = 1 and not clearly and rate <= bar)) as kept,
  failures, round(rate, 9) + 0.0::double as host_rate
from marked m join rates r on m.source is not distinct from r.source
"""


@query("op4_host_rules", HOST_RULES_SQL)
def host_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return quality_rules(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "failures",
        F.round("host_rate", 9).alias("host_rate"),
    )


@query("op5_simple8b_ids")
def simple8b_ids(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents")
    return simple8b.read_ids(simple8b.write_ids(docs, public_tokenizers.path("word_bpe_49k.json")))


PERSPECTIVES_SQL = """
with said as (
  select conv_id, coalesce(floor(turn / 4096), 0)::integer as part, turn, role as who,
    replace(coalesce(text, ''), '<|', '< |') as text, coalesce(text, '') as raw
  from conversations
), views as (
  select distinct conv_id, role as speaker from conversations where role is not null and role <> 'system'
), segments as (
  select s.conv_id, part, speaker, turn, who, s.text, coalesce(who = speaker, false) as own,
    '<|im_start|>' || case when who = 'system' then 'system' when who = speaker then 'assistant'
      else 'user name=' || translate(coalesce(who, 'unknown'), chr(13) || chr(10), '  ') end || chr(10) as head
  from said s join views v on s.conv_id is not distinct from v.conv_id
), placed as (
  select *, sum(length(head) + length(text) + 11) over (
    partition by conv_id, part, speaker order by turn nulls first, who nulls first, text
    rows between unbounded preceding and current row) as done
  from segments
)
select conv_id, speaker, part, count(*) as n_turns, count(*) filter (where own) as n_own,
  string_agg(head || text || '<|im_end|>' || chr(10), '' order by turn nulls first, who nulls first, text) as rendered,
  coalesce(string_agg((done - length(text) - 11)::bigint::varchar || '-' || (done - 1)::bigint::varchar, ' '
    order by turn nulls first, who nulls first, text) filter (where own), '') as mask
from placed group by conv_id, speaker, part
"""


@query("op6_perspectives", PERSPECTIVES_SQL)
def perspectives(spark: SparkSession, folder: str) -> DataFrame:
    views = rotate(table(spark, folder, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return views.withColumn("mask", F.array_join(spans, " "))


@query("op8_spaced_seeds")
def spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


WARC_SQL = """
with p as (
  select page_id, coalesce(html, '') as body from pages
), m as (
  select page_id, strlen(body)::bigint as n, sha1(body) as digest, max(page_id) over (partition by body) as top from p
)
select page_id, n as payload_bytes, digest as payload_digest,
  case when n >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id < top then top end as refers_to, true as payload_ok
from m
"""


@query("op9_warc_bundles", WARC_SQL)
def warc_bundles(spark: SparkSession, folder: str) -> DataFrame:
    return warc_zstd.read_bundles(warc_zstd.write_bundles(table(spark, folder, "pages")))


@query("op10_block_anchors")
def block_anchors(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


@query("op2_class_bigrams")
def class_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return score_documents(table(spark, folder, "documents"), held_out)


@query("op7_jaccard_rtree")
def jaccard_rtree(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


LINES_SQL = r"""
with split as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), placed as (
  select doc_id, unnest(range(1, len(lines) + 1)) as place, unnest(lines) as line from split
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from placed
), held as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), judged as (
  select k.doc_id, place, line, h.key is not null and k.doc_id <> h.keeper as goes from keyed k left join held h on k.key = h.key
)
select doc_id, count(*) as n_lines, count(*) filter (where goes) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not goes), '')) as kept_sha256
from judged group by doc_id
"""


@query("op12_line_dedup", LINES_SQL)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = deduplicated(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def lloyd_sql(rounds: int = 6, entries: int = 16, parts: int = 8) -> str:
    """Lloyd rounds, one after the other, in exact integers."""
    steps = [
        f"""with kept as (
  select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), parts as materialized (
  select vec_id, label, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] as x from kept, range({parts}) t(p)
), book0 as materialized (
  select p, e, x as c from (select p, x, row_number() over (partition by p order by vec_id) - 1 as e from parts) where e < {entries}
)"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""near{i} as materialized (
  select vec_id, label, p, x, min(struct_pack(d := d, e := e)) as best
  from (select vec_id, label, p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from parts join book{i} using (p))
  group by vec_id, label, p, x
)"""
        )
        if i < rounds:
            steps.append(
                f"""mean{i} as (
  select p, e, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as c
  from (select p, best.e as e, j, sum(x[j])::hugeint as s, count(*) as n from near{i}, range(1, 1025) t(j) where j <= len(x) group by p, best.e, j)
  group by p, e
), book{i + 1} as materialized (
  select b.p, b.e, coalesce(m.c, b.c) as c from book{i} b left join mean{i} m on b.p = m.p and b.e = m.e
)"""
            )
    return ", ".join(steps) + f""", flat as (
  select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from book{rounds}
), coded as (
  select vec_id, label, string_agg(printf('%02x', best.e), '' order by p) as code, sum(best.d)::bigint as error
  from near{rounds} group by vec_id, label
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from coded, flat"""


@query("op13_vector_codes", lloyd_sql())
def lloyd_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes(table(spark, folder, "embeddings")).drop("label")


COLLOCATIONS_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), spoken as (
  select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as ws from pieces
), sizes as (
  select lang, sum(len(ws))::bigint as n from spoken group by lang
), grams as (
  select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase
  from spoken, range(1, 6) t(k) where len(ws) >= k
), found as materialized (
  select lang, k, phrase, count(*) as f from grams group by lang, k, phrase having count(*) >= 100
), cuts as (
  select c.lang, c.k, c.phrase, c.f as a, l.f as l, r.f as r, n, j, (1000::hugeint * c.f * n) // (l.f::hugeint * r.f) as score
  from found c, range(1, 5) t(j), found l, found r, sizes s
  where j < c.k and l.lang = c.lang and r.lang = c.lang and s.lang = c.lang
    and l.phrase = array_to_string(string_split(c.phrase, ' ')[1:j], ' ')
    and r.phrase = array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ')
), weakest as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1
), kept as (
  select * from weakest w where not exists (
    select 1 from found b where b.lang = w.lang and b.k > w.k and 100 * b.f >= 100 * w.a
      and contains(' ' || b.phrase || ' ', ' ' || w.phrase || ' '))
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked where rank <= 2000
"""


@query("op11_collocations", COLLOCATIONS_SQL)
def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents").select("lang", "text"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
