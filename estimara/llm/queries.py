"""One query for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, lexical, licenses, linededup, quality, shared, simhash, tokencount, tokenfile, toxicity, urls, whitening

#: The rules of op6 in their order.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(_table(spark, sf_dir, "documents"), n=4, bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(_table(spark, sf_dir, "pages"), RULES)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared.folder(spark, "tokens")
    tokenfile.write_tokens(_table(spark, sf_dir, "documents"), at, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenfile.token_digests(spark, at)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digests(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_license_scan, op2_quality_rules, op3_token_counts, op4_simhash, op5_byte_bpe, op6_url_filter, op7_decontaminate, op8_token_file, op9_line_dedup, op10_toxicity, op11_language_id, op12_embedding_whitening, op13_lexical_search, pipeline]
    return {f.__name__: f for f in own}


_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quality_sql() -> str:
    words = _WORDS.format(text="text")
    return rf"""with base as (select doc_id, source as host, coalesce(text, '') as text, {words} as words from documents),
    windows as (select doc_id, i, array_to_string(words[i:i + 7], ' ') as w from (select doc_id, words, unnest(generate_series(1, len(words) - 7)) as i from base where len(words) >= 8)),
    again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w) as n from windows) where n > 1),
    repeats as (select doc_id, count(distinct j) as n from (select doc_id, unnest(generate_series(i, i + 7)) as j from again) group by doc_id),
    lines as (select doc_id, unnest(string_split(text, chr(10))) as line from base),
    dups as (select doc_id, sum(n - 1) as n from (select doc_id, line, count(*) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id, line) group by doc_id),
    measured as (select doc_id, host, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(d.n, 0)::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
        from base left join dups d using (doc_id) left join repeats r using (doc_id)),
    failed as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed from measured),
    hosts as (select host, count(*) as n, sum(base_failed::int) as f from failed where host is not null group by host),
    sums as (select count(*)::double as k, sum(n)::double as n, sum(f)::double / sum(n) as m, sum(n::double * n) as squares from hosts),
    spread as (select any_value(m) as m, sum(hosts.n * pow(f / hosts.n::double - m, 2)) - (any_value(k) - 1) * any_value(m) * (1 - any_value(m)) as over, any_value(m) * (1 - any_value(m)) * (any_value(sums.n) - any_value(squares) / any_value(sums.n) - (any_value(k) - 1)) as room from hosts, sums),
    prior as (select m, case when room > 0 and over / room > 1e-6 then greatest(room / over - 1, 1e-6) else 1e6 end as strength from spread),
    verdicts as (select host, (f + m * strength) / (n + strength) as rate from hosts, prior)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(rate > {quality.MAX_HOST_RATE}, false) as kept, round(rate, 6) as host_rate
    from failed left join verdicts using (host)"""


def _decontam_sql() -> str:
    words = lambda t: rf"regexp_extract_all(translate(coalesce({t}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""with items as (select item_id, {words("text")} as words from benchmark), docs as (select doc_id, {words("text")} as words from documents),
    item_windows as (select distinct item_id, span, array_to_string(words[i:i + span - 1], ' ') as w from (select item_id, words, least(10, len(words)) as span, unnest(generate_series(1, len(words) - least(10, len(words)) + 1)) as i from items where len(words) > 0)),
    spans as (select distinct span from item_windows),
    doc_windows as (select doc_id, span, i, array_to_string(words[i:i + span - 1], ' ') as w from (select doc_id, words, span, unnest(generate_series(1, len(words) - span + 1)) as i from docs, spans where len(words) >= span)),
    hits as (select doc_id, item_id, i, span from doc_windows join item_windows using (span, w)),
    hit_words as (select doc_id, count(distinct j) as n from (select doc_id, unnest(generate_series(i, i + span - 1)) as j from hits) group by doc_id),
    hit_items as (select doc_id, count(distinct item_id) as n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by doc_id)
    select doc_id, len(words)::bigint as n_words, coalesce(w.n, 0)::bigint as n_hit, coalesce(i.n, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(w.n, 0) > 0 as contaminated
    from docs left join hit_words w using (doc_id) left join hit_items i using (doc_id)"""


def _lines_sql() -> str:
    return rf"""with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
    keyed as (select doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') as key from lines),
    first as (select key, min(doc_id) as holder from keyed where length(key) >= {linededup.MIN_CHARS} group by key),
    judged as (select doc_id, i, line, coalesce(doc_id > holder, false) as gone from keyed left join first using (key))
    select doc_id, count(*)::bigint as n_lines, sum(gone::int)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from judged group by doc_id"""


def _urls_sql() -> str:
    """The rounds of the propagation are a recursive sum."""
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '{r[len(r.partition('/')[0]):]}')" for v, r in RULES)
    link = urls.LINK.replace("'", "''")
    flow = lambda name, seed, edges: f"""{name}(host, value, round) as (select host, {1 - urls.DAMPING} * {seed}, 0 from seeds where {seed} > 0 union all
        select dst, {urls.DAMPING} * sum(value * share), round + 1 from {name} join {edges} on src = host where round < {urls.ROUNDS} group by dst, round)"""  # noqa: E731
    return f"""with recursive parsed as (select page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
    rules(v, rule, rule_host, rule_path) as (values {rules}),
    best as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(v, length(rule)) as v from parsed, rules where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by page_id),
    judged as (select page_id, host, path, rule, v from parsed left join best using (page_id)),
    seeds as (select host, avg((coalesce(v, '') = 'allow')::int) as allow, avg((coalesce(v, '') = 'block')::int) as block from judged where host <> '' group by host),
    links as (select src, dst, count(*)::double as n from (select host as src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{_UPPER}', '{_LOWER}') as dst from parsed) where src <> '' and dst <> src group by src, dst),
    onward as (select src, dst, n / sum(n) over (partition by src) as share from links),
    back as (select dst as src, src as dst, share / sum(share) over (partition by dst) as share from onward),
    {flow("trust", "allow", "onward")}, {flow("distrust", "block", "back")},
    bad as (select host from (select host, value from distrust union all select host, -value from trust) group by host having sum(value) > {urls.THRESHOLD})
    select page_id, host, path, rule, coalesce(v, case when host in (select host from bad) then 'block' else 'allow' end) as verdict from judged"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.license_sql(), "op2_quality_rules": _quality_sql(), "op6_url_filter": _urls_sql(), "op7_decontaminate": _decontam_sql(), "op9_line_dedup": _lines_sql(), "op13_lexical_search": lexical.search_sql()}
