"""The registered queries of this subpackage: thin digests over the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import bpe, chat, jaccard, mixing, quality, substring, suffix, topk, toxicity, warc
from riskweave.llm.scratch import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Content of a public tokenizer file, read where it is installed."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary())


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~held_out()))
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


#: A conversation that consists of control strings of a usual template.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.format_and_read(turns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_links(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_toxicity, op3_chat, op4_quality, op5_topk, op6_mixing, op7_jaccard, op8_warc, op9_suffix, op10_substring, pipeline)}


ORACLES = {
    "op8_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        d as (select page_id, strlen(html) as size, sha256(html) as digest from p),
        f as (select *, min(page_id) over (partition by digest) as first_id from d)
        select page_id, cast(size as bigint) as payload_bytes, digest as payload_digest,
               case when size >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
               case when size >= 100 and page_id <> first_id then first_id end as refers_to
        from f""",
    "op5_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
                   where embedding is not null),
        s as (select q.vec_id as query_id, c.vec_id as vec_id,
                     cast(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])) as bigint) as score
              from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0)
        select query_id, cast(rank as integer) as rank, vec_id, score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""",
}

#: Words of a text as a list.
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES["op3_chat"] = rf"""
    with said as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '{CONTROL_TEXT}' union all select -7, 1, 'assistant', '{CONTROL_TEXT}'),
    turns as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as i, len({_WORDS.format("text")}) + {chat.TURN_COST} as tokens,
            13 + length(role) + length(regexp_replace(role, '[^\\<\[|]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) as chars from said),
    opening as (select conv_id, min(i) as si, arg_min(tokens, i) as st, arg_min(chars, i) as sc from turns where role = 'system' group by conv_id),
    placed as (select t.*, si, coalesce(st, 0) as st, coalesce(sc, 0) as sc, greatest({{budget}} - coalesce(st, 0), 1) as stride, sum(tokens) over (partition by t.conv_id order by i) as upto from turns t left join opening o on o.conv_id is not distinct from t.conv_id),
    dealt as (select *, (upto - tokens) // stride as a, (upto - 1) // stride as b, lag(tokens) over w as t1, lag(chars) over w as c1, lag(tokens, 2) over w as t2, lag(chars, 2) over w as c2 from placed window w as (partition by conv_id order by i)),
    spans as (select conv_id, a, a <> b as crosses, min(i) as f, sum(tokens) as own, sum(chars) as chars, any_value(si) as si, any_value(st) as st, any_value(sc) as sc,
            arg_min(coalesce(t1, -1), i) as t1, arg_min(coalesce(c1, -1), i) as c1, arg_min(coalesce(t2, -1), i) as t2, arg_min(coalesce(c2, -1), i) as c2 from dealt group by conv_id, a, crosses),
    roomy as (select *, coalesce(si < f, false) as opens, {{budget}} - own - case when coalesce(si < f, false) then st else 0 end as room, case when f >= 1 and not coalesce(si = f - 1, false) then t1 else 0 end as near_tokens,
            case when f >= 1 and not coalesce(si = f - 1, false) then c1 else 0 end as near_chars, case when f >= 2 and not coalesce(si = f - 2, false) then t2 end as far_tokens from spans),
    windows as (select conv_id, chars + case when opens then sc else 0 end + case when near_tokens <= room then near_chars else 0 end + case when far_tokens is not null and far_tokens + near_tokens <= room then c2 else 0 end as chars from roomy),
    sized as (select conv_id, cast(sum(chars) as bigint) as formatted_chars from windows group by conv_id),
    told as (select conv_id, cast(count(*) as bigint) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256, coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '') as loss from turns group by conv_id)
    select t.conv_id, n_turns, turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from told t join sized s on t.conv_id is not distinct from s.conv_id""".replace("{budget}", str(chat.BUDGET))

_HOST_RATES = ", ".join(f"sum(cast(({rule}) as integer)) as n_{name}" for name, rule in quality.RULES.items())
_MOMENTS = ", ".join(f"sum(n_{k}) / sum(n_docs) as m_{k}, sum(n_{k} * n_{k} / n_docs) / sum(n_docs) as q_{k}" for k in quality.RULES)
_BETWEEN = ", ".join(f"m_{k}, q_{k} - m_{k} * m_{k} - m_{k} * (1 - m_{k}) * hosts / n as b_{k}" for k in quality.RULES)
_WEIGHT = ", ".join(f"m_{k}, case when b_{k} > 0 then greatest(m_{k} * (1 - m_{k}) / b_{k} - 1, 0.0) end as w_{k}" for k in quality.RULES)
_RATE = ", ".join(f"m_{k}, w_{k}, coalesce((n_{k} + m_{k} * w_{k}) / (n_docs + w_{k}), m_{k}) as r_{k}" for k in quality.RULES)
_FAILS = " or ".join(f"r_{k} - 2 * coalesce(sqrt(r_{k} * (1 - r_{k}) / (n_docs + w_{k} + 1)), 0.0) > greatest(2.0 * m_{k}, 0.2)" for k in quality.RULES)
ORACLES["op4_quality"] = rf"""
    with doc as (select row_number() over () as row_, doc_id, source, coalesce(text, '') as text from documents),
    split as (select *, {_WORDS.format("text")} as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) as lines from doc),
    places as (select row_, unnest(generate_series(1, len(words) - 7)) as i, words from split where len(words) >= 8),
    windows as (select row_, i, array_to_string(words[i:i + 7], ' ') as w from places),
    twice as (select row_, i from (select *, count(*) over (partition by row_, w) as n from windows) where n > 1),
    covered as (select row_, count(distinct place) as n from (select row_, unnest(generate_series(i, i + 7)) as place from twice) group by row_),
    base as (select s.row_, doc_id, source, cast(len(words) as bigint) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
            cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, len(lines) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words
            from split s left join covered c using (row_)),
    judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from base),
    hosts as (select source, count(*) as n_docs, {_HOST_RATES} from judged group by source),
    moments as (select sum(n_docs) as n, count(*) as hosts, {_MOMENTS} from hosts),
    prior as (select {_WEIGHT} from (select {_BETWEEN} from moments)),
    rated as (select source, n_docs, {_RATE} from hosts, prior),
    bad as (select source, {_FAILS} as host_failed from rated)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not host_failed as kept from judged j join bad b on j.source is not distinct from b.source"""

ORACLES["op7_jaccard"] = rf"""
    with recursive doc as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
    sets as (select doc_id, list_distinct(case when len(w) >= 4 then list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else cast([] as varchar[]) end) as s from doc),
    flat as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
    pairs as (select a.doc_id as a, b.doc_id as b, count(*) as k, any_value(a.n) as na, any_value(b.n) as nb from flat a join flat b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
    links as (select a, b from pairs where 100 * k >= 85 * (na + nb - k)),
    both_ways as (select a, b from links union all select b, a from links),
    reach as (select doc_id, doc_id as r from sets union select x.doc_id, l.b from reach x join both_ways l on x.r = l.a)
    select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.r) as component_id from sets s join reach r on r.doc_id = s.doc_id group by s.doc_id, len(s.s)"""

ORACLES["op9_suffix"] = """
    with doc as (select row_number() over () as row_, doc_id, encode(coalesce(text, '')) as raw, octet_length(encode(coalesce(text, ''))) as n from documents),
    starts as (select row_, unnest(generate_series(1, n - 399)) as p from doc where n >= 400),
    keyed as (select row_, p, md5(hex(raw[p:p + 399])) as h from starts join doc using (row_)),
    repeated as (select row_, p from (select *, count(*) over (partition by h) as times from keyed) where times > 1),
    edged as (select *, coalesce(p > lag(p) over (partition by row_ order by p) + 400, true) as new from repeated),
    numbered as (select *, sum(cast(new as integer)) over (partition by row_ order by p) as run from edged),
    runs as (select row_, run, min(p) as a, max(p) + 399 as b from numbered group by row_, run),
    gaps as (select row_, a, b, coalesce(lag(b) over (partition by row_ order by a), 0) as before from runs),
    kept as (select row_, count(*) as n_spans, sum(b - a + 1) as n_removed, max(b) as last, string_agg(hex(raw)[2 * before + 1:2 * (a - 1)], '' order by a) as head from gaps join doc using (row_) group by row_),
    short as (select row_, p, md5(hex(raw[p:p + 249])) as h from (select row_, unnest(generate_series(1, n - 249)) as p from doc where n >= 250) join doc using (row_)),
    passages as (select row_, p from short where h in (select h from short group by h having min(row_) <> max(row_))),
    steps as (select row_, least(250, p - coalesce(lag(p) over (partition by row_ order by p), p - 250)) as fresh from passages),
    shared as (select row_, sum(fresh) as n_shared from steps group by row_)
    select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
        case when n_spans is null then sha256(raw) else sha256(unhex(head || hex(raw)[2 * last + 1:])) end as kept_sha256, cast(coalesce(n_shared, 0) as bigint) as n_shared
    from doc left join kept using (row_) left join shared using (row_)"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = dict(ORACLES)
    if corpus_pipeline.ORACLE_SQL is not None:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
