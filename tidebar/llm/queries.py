"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, importance_sample, lexical_search, license_scan, order_minhash, quality_rules, secret_scan, token_counts, unit_dedup, warc
from . import toxicity as tox
from .common import table
from .decontaminate import contamination


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tox.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents")).drop("rid", "all_spans")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.recount_derived(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op9_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.repeated_passages(table(spark, sf_dir, "documents")).drop("rid")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_toxicity, op3_secrets, op4_decontaminate, op5_near_dedup, op6_licenses, op7_token_counts, op8_bpe, op9_unit_dedup, op10_warc, op11_lexical_search, op12_importance_sample, op13_quality_rules)}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op1_embedding_dedup": """
        with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where embedding is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
        r(n, c) as (select vec_id, vec_id from embeddings union select p.b, r.c from r join p on p.a = r.n),
        m as (select n, min(c) as c from r group by 1), k as (select a, count(*) as n_links from p group by 1)
        select n as vec_id, coalesce(n_links, 0)::bigint as n_links, c as component_id, n = c as kept from m left join k on k.a = m.n
    """,
    "op10_warc": """
        with p as (select page_id, coalesce(html, '') as h from pages),
        d as (select page_id, octet_length(encode(h)) as payload_bytes, sha256(h) as payload_digest from p),
        f as (select *, min(page_id) over (partition by payload_digest) as first from d)
        select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
               case when payload_bytes >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 100 and page_id > first then first end as refers_to
        from f
    """,
    "op4_decontaminate": r"""
        with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
        b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
        bs as (select item_id, w, least(13, len(w)) as n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0),
        bw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from bs),
        ds as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
        sizes as (select distinct n from bw),
        dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g from ds, sizes where i + n - 1 <= len(w)),
        m as (select doc_id, i, dw.n, item_id from dw join bw on dw.n = bw.n and dw.g = bw.g),
        h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by 1),
        t as (select doc_id, count(distinct item_id) as n_items, sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) as s from m group by 1)
        select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
               coalesce(s, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join h using (doc_id) left join t using (doc_id)
    """,
    "op11_lexical_search": r"""
        with d as (select doc_id, WORDS as w from documents),
        q as (select distinct item_id, unnest(WORDS) as term from benchmark),
        c as (select (count(*) filter (len(w) > 0))::bigint as n_all, sum(len(w))::bigint as total from d),
        p as (select doc_id, n, term, count(*) as tf from (select doc_id, len(w) as n, unnest(w) as term from d) group by 1, 2, 3),
        f as (select term, count(*) as df from p group by 1),
        g as (select term, floor(1000 * ln((2 * n_all + 2) / (2 * df + 1)))::bigint as w from f, c),
        s as (select item_id, doc_id, sum(g.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // total))))::bigint as score
              from q join p using (term) join g using (term), c group by 1, 2)
        select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 50
    """.replace("WORDS", _WORDS),
    "op12_importance_sample": r"""
        with recursive bits(n, c, step) as (select range, range, 0 from range(256) union all select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, step + 1 from bits where step < 8),
        crc as (select list(c order by n) as t from bits where step = 8),
        d as (select doc_id, WORDS as w from documents),
        dw as (select doc_id, word, count(*) as times from (select doc_id, unnest(w) as word from d) group by 1, 2),
        bw as (select word, count(*) as times from (select unnest(WORDS) as word from benchmark) group by 1),
        words as (select distinct word from (select word from dw union all select word from bw)),
        hexes as (select word, hex(encode(word)) as x from words),
        b as (select word, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::bigint), lambda a, y: xor(a >> 8, t[xor(a & 255, y) + 1]), 4294967295), 4294967295) % 10000 as bucket from hexes, crc),
        s as (select bucket, sum(times)::bigint as s from dw join b using (word) group by 1),
        t as (select bucket, sum(times)::bigint as t from bw join b using (word) group by 1),
        n as (select (select coalesce(sum(s), 0)::bigint from s) as s_all, (select coalesce(sum(t), 0)::bigint from t) as t_all),
        g as (select bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000)) / ((coalesce(s, 0) + 1) * (t_all + 10000))))::bigint as gain from s full join t using (bucket), n),
        x as (select doc_id, sum(times * gain)::bigint as weight from dw join b using (word) join g using (bucket) group by 1),
        y as (select doc_id, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight, ('0x' || sha256('2024:' || doc_id)[1:8])::bigint as h from d left join x using (doc_id)),
        z as (select doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))))::bigint as score from y),
        r as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from z where n_features >= 20)
        select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank from z left join r using (doc_id)
    """.replace("WORDS", _WORDS),
    "op13_quality_rules": r"""
        with a as (select doc_id, lang as stratum, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
        g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from a)),
        h as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g) where n > 1),
        c as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from h) group by 1),
        m as (select a.doc_id, stratum, len(w)::bigint as n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars, len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
              (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines,
              len(regexp_replace(text, '[^\p{Lu}]+', '', 'g'))::bigint as n_capitals, len(regexp_replace(text, '[^!]+', '', 'g'))::bigint as n_exclamations, len(list_filter(w, lambda x: not regexp_matches(x, '[\p{L}\p{N}]')))::bigint as n_lone
              from a left join c using (doc_id)),
        v as (select doc_id, stratum, unnest(['symbols', 'capitals', 'exclamations', 'repeated_words', 'repeated_lines', 'lone_symbols']) as rule,
              unnest([n_symbols / nullif(word_chars, 0), n_capitals / nullif(word_chars, 0), n_exclamations / nullif(n_words, 0), n_repeat_words / nullif(n_words, 0), n_dup_lines / nullif(n_lines, 0), n_lone / nullif(n_words, 0)]) as x from m),
        u as (select doc_id, stratum, rule, floor(least(coalesce(x, 0), 1.0::double) * 1000)::int as step from v),
        k as (select doc_id, min(quality) = 1 as good from labels where quality in (0, 1) group by 1 having min(quality) = max(quality)),
        l as (select stratum, rule, step, good from u join k using (doc_id)),
        s as (select stratum, rule, count(*) filter (good) as n_good, count(*) filter (not good) as n_bad from l group by 1, 2),
        tests as (select count(*) as tests from s),
        p as (select n_good, j, sum(exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln(0.03::double / 6) + (n_good - j) * ln(1 - 0.03::double / 6))) over (partition by n_good order by j) as cdf
              from (select n_good, unnest(range(0, ceil(n_good * 0.03::double / 6)::bigint + 1)) as j from (select distinct n_good from s)) where j <= n_good),
        o as (select n_good, max(j) as allowed from p, tests where cdf <= 0.05::double / tests group by 1),
        e as (select s.stratum, s.rule, b.step, n_good, n_bad, count(*) filter (l.good and l.step > b.step) as good_above, count(*) filter (not l.good and l.step > b.step) as bad_above
              from s join (select distinct stratum, rule, step from l) b on s.rule = b.rule and s.stratum is not distinct from b.stratum join l on l.rule = b.rule and l.stratum is not distinct from b.stratum group by 1, 2, 3, 4, 5),
        f as (select stratum, rule, min(step) as cutoff from e join o using (n_good) where good_above <= allowed group by 1, 2),
        z as (select f.* from f join e on e.rule = f.rule and e.stratum is not distinct from f.stratum and e.step = f.cutoff where bad_above > 0 and bad_above * n_good >= 5 * good_above * n_bad),
        r as (select u.doc_id, string_agg(u.rule, ',' order by u.rule) as rejected_by from u join z on u.rule = z.rule and u.stratum is not distinct from z.stratum where u.step > z.cutoff group by 1)
        select doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, coalesce(rejected_by, '') as rejected_by,
               not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and rejected_by is null as kept
        from m left join r using (doc_id)
    """,
}
