"""The corpus queries ``opN_<name>`` with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontam, exact_dedup, filter_audit, langid, line_dedup, sharding, simhash, source_audit, suffix_dedup, token_counts, url_filter
from .common import table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, _ = url_filter.split_url("url")
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "pages"), host, line_dedup.html_text("html"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).drop("distance")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the table and one conversation more, whose texts are full of control strings."""
    said = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(chats.unionByName(added))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_sharding": op6_sharding,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_language_id": op9_language_id,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_chat_format": op11_chat_format,
    "op12_filter_audit": op12_filter_audit,
    "op13_source_audit": op13_source_audit,
}

_LABELS = " or ".join(f"contains('.' || host || '.', '.{w}.') or contains('.' || host, '.{w}:')" for w in url_filter.BLOCKED_LABELS)
_RULES = ", ".join(
    f"('{spec}', '{verdict}', '{spec.partition('/')[0]}', '/{spec.partition('/')[2]}', {len(spec)})" for verdict, spec in url_filter.SITE_RULES
)

_HOST = r"""translate(regexp_extract(case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end, '^[^/?#]*'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
_WORDS = r"""[x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> '']"""

#: The CRC-32 of a text's bytes by the usual table of 256 remainders, built from its polynomial.
_CRC_TABLE = """(select [list_reduce(list_prepend(k::bigint, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
                lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) for k in range(256)] as remainders)"""
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, [('0x' || x)::bigint for x in bytes if x <> '']),
                lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1])), 4294967295)"""

#: What the template makes of a text: backslashes doubled, control strings broken by one.
_ESCAPED = r"""replace(replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '<part/>', '<\part/>'), '</turn>', '<\/turn>')"""
_TERMS = _WORDS.replace(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+")

ORACLE_SQL: dict[str, str] = {
    "op11_chat_format": rf"""
        with c as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, k, said, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) t(k, said)),
        t as (
            select *, row_number() over o as n, role is not distinct from lag(role) over o as goes_on,
                   case role when 'user' then 'User' when 'assistant' then 'Assistant' when 'system' then 'System'
                        else 'role ' || replace({_ESCAPED.replace("(text", "(role")}, ': ', ':\ ') end as name,
                   {_ESCAPED} as escaped
            from c window o as (partition by conv_id order by turn nulls first, role, text))
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
               coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
               sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
               sum(length(escaped) + case when goes_on then length('<part/>') else length('### ' || name || ': ' || '</turn>' || chr(10)) end)::bigint as formatted_chars
        from t group by conv_id
    """,
    "op12_filter_audit": r"""
        with w as (
            select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
                   [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as words, min(doc_id) over (partition by coalesce(text, '')) as first
            from documents),
        l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by 1),
        d as (
            select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
                   [f[1] for f in [('A', len(words) < 50), ('B', 100 * len(list_distinct(words)) < 65 * len(words)),
                       ('C', 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text)), ('D', regexp_matches(text, '[#$%&*|]')),
                       ('E', coalesce(w.doc_id > first, w.doc_id is null and first is not null))] if f[2]] as failed
            from w left join l using (doc_id)),
        m as (select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from d group by all),
        f as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
        o as (select a.x || b.x || c.x || d.x || e.x as filter_order from f a, f b, f c, f d, f e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s as (select filter_order, k::int as step, filter_order[k:k] as own, string_split(filter_order[1:k - 1], '') as prior from o, range(1, 6) t(k)),
        r as (
            select part, filter_order, step, own,
                   sum(n) filter (not list_contains(failed, own) and not list_has_any(failed, prior)) as kept,
                   sum(n) filter (list_contains(failed, own) and not list_has_any(failed, prior)) as removed,
                   sum(n) filter (list_contains(failed, own) and list_has_any(failed, prior)) as redundant,
                   sum(n) filter (failed = [own]) as unique_fails,
                   sum(good) filter (list_contains(failed, own) and not list_has_any(failed, prior)) as good_lost,
                   sum(toxic) filter (list_contains(failed, own) and not list_has_any(failed, prior)) as toxic_lost
            from m, s group by all)
        select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
               coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
               coalesce(sum(removed) over (partition by part, own), 0)::bigint as shapley
        from r
    """,
    "op13_source_audit": rf"""
        with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, {_TERMS} as words from documents),
        t as (select r, lang, source, unnest(words) as term from d),
        k as (select lang, term from t group by 1, 2 having count(distinct r) >= {source_audit.MIN_DOCS}),
        v as (select lang, count(term) as v from (select distinct lang from d) left join k using (lang) group by 1),
        g as (select distinct lang, source from d),
        c as (select lang, source, term, count(*) as n from t join k using (lang, term) group by all),
        p as (
            select lang, source, term, coalesce(n, 0) as n,
                   1 + 1000000000::hugeint * (coalesce(n, 0) + 5) // (sum(coalesce(n, 0)) over (partition by lang, source) + 5 * v) as p
            from g join v using (lang) join k using (lang) left join c using (lang, source, term)),
        q as (
            select lang, term, 1 + 1000000000::hugeint * (n + 5) // (sum(n) over (partition by lang) + 5 * v) as q
            from (select lang, term, sum(n) as n from c group by 1, 2) join v using (lang)),
        f as (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term group by all),
        a as (
            select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
            from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
            union all select lang, source, 'term', term, p - q from p join q using (lang, term) where n > 0 and p > q)
        select lang, source, part, item, value::bigint as value, rank::int as rank
        from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from a)
        where part = 'pair' or rank <= {source_audit.TOP}
    """,
    "op6_sharding": rf"""
        with d as (
            select doc_id, strlen(coalesce(text, ''))::bigint + 1 as size,
                   string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\1,', 'g'), ',') as bytes from documents),
        c as (select doc_id, size, {_CRC} as text_crc32 from d, {_CRC_TABLE}),
        p as (
            select *, row_number() over o as n, 2 * (sum(size) over o - size) + size as middle, 2 * sum(size) over () as twice
            from c window o as (order by doc_id nulls first, text_crc32, size rows between unbounded preceding and current row)),
        s as (select *, (middle * 8 // twice)::int as shard from p)
        select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by n) - 1 as slot, null::int as grown_shard
        from s
    """,
    "op4_line_dedup": rf"""
        with p as (
            select row_number() over () as r, page_id, coalesce({_HOST}, '') as host,
                   [y for y in [regexp_replace(x, '^\s+|\s+$', '', 'g') for x in string_split(
                       regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{line_dedup.HIDDEN}', chr(10), 'g'),
                       '{line_dedup.BLOCK}', chr(10), 'g'), '{line_dedup.TAG}', '', 'g'), chr(10))] if y <> ''] as lines from pages),
        seen as (select distinct r, host, unnest(lines) as line from p),
        common as (
            select host, line from seen join (select host, count(*) as pages from p group by 1) using (host)
            where host <> '' group by host, line, pages having count(*) >= {line_dedup.MIN_PAGES} and count(*) > {line_dedup.RATIO} * pages),
        gone as (select host, list(line) as gone from common group by host)
        select page_id, host, len(lines) as n_lines, len(lines) - len(kept) as n_dropped, array_to_string(kept, chr(10)) as text
        from (select *, [x for x in lines if not coalesce(list_contains(gone, x), false)] as kept from p left join gone using (host))
    """,
    "op8_decontamination": rf"""
        with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
        i as (select distinct coalesce(item_id::varchar, '') as item, {_WORDS} as w from benchmark),
        iw as (
            select distinct item, l, array_to_string(w[a:a + l - 1], ' ') as gram
            from (select item, w, least({decontam.WINDOW}, len(w)) as l, unnest(range(1, len(w) - least({decontam.WINDOW}, len(w)) + 2)) as a from i where len(w) > 0)),
        dw as (
            select r, l, a, array_to_string(w[a:a + l - 1], ' ') as gram
            from (select r, w, l, unnest(range(1, len(w) - l + 2)) as a from d cross join (select distinct l from iw) where len(w) >= l)),
        m as (select r, a, l, item from dw join iw using (l, gram)),
        h as (select r, count(*) as n_hit from (select distinct r, unnest(range(a, a + l)) as p from m) group by r),
        f as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from m) group by r)
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 as contaminated
        from d left join h using (r) left join f using (r)
    """,
    "op2_exact_dedup": r"""
        with d as (
            select doc_id, length(coalesce(text, '')) as points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
            from documents)
        select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
               row_number() over w = 1 as kept, text_sha256
        from d window w as (partition by text_sha256 order by points desc, doc_id nulls last
                            rows between unbounded preceding and unbounded following)
    """,
    "op3_url_filters": rf"""
        with u as (
            select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
        h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u),
        p as (
            select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
        r(rule, verdict, rhost, rpath, len) as (values {_RULES}),
        f as (
            select p.page_id, p.host, p.path, r.rule, r.verdict,
                   row_number() over (partition by p.page_id order by r.len desc nulls last) as n
            from p left join r on (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath))
        select page_id, host, path, rule,
               coalesce(verdict, case when {_LABELS} then 'block' else 'allow' end) as verdict
        from f where n = 1
    """,
}
