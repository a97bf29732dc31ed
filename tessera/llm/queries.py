"""The registered corpus queries and their SQL."""

from pyspark.sql import functions as F

from tessera.llm import cover_tree, jaccard, licenses, merkle, mixing, packing, pieces, preference, quality, secrets, sharding, suffix_dedup
from tessera.llm.common import read


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_suffix_dedup(spark, d):
    return suffix_dedup.remove_repeats(read(spark, d, "documents"))


def op2_embedding_dedup(spark, d):
    return cover_tree.near_duplicates(read(spark, d, "embeddings"))


def op3_quality_rules(spark, d):
    return quality.apply_rules(read(spark, d, "documents"))


def op4_best_fit_packing(spark, d):
    return packing.pack_documents(read(spark, d, "documents"), *tokenizer_paths())


def op5_chat_formatting(spark, d):
    return preference.format_pairs(preference.pair_neighbours(read(spark, d, "conversations")))


def op6_license_scans(spark, d):
    return licenses.scan(read(spark, d, "documents"))


def op7_secret_scans(spark, d):
    return secrets.scan(read(spark, d, "documents"))


def op8_source_mixing(spark, d):
    return mixing.mix_documents(read(spark, d, "documents"))


def op9_jaccard_join(spark, d):
    return jaccard.similar_documents(read(spark, d, "documents"))


def op10_sharding(spark, d):
    return sharding.shard_documents(read(spark, d, "documents"))


def op11_piece_encoding(spark, d):
    back = pieces.round_trip(read(spark, d, "documents"), piece_model_path())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark, d):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    rows = merkle.manifest(read(spark, d, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], changed=changed)
    root = merkle.folded(F.col("changed_leaf"), F.col("proof"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("proof")).alias("proof_sha256"), root.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_embedding_dedup, op3_quality_rules, op4_best_fit_packing, op5_chat_formatting, op6_license_scans, op7_secret_scans, op8_source_mixing, op9_jaccard_join, op10_sharding, op11_piece_encoding, op12_merkle_manifest)}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(column: str) -> str:
    t = f"regexp_replace(lower({column}), {_sql(licenses.COPYRIGHT_LINE)}, chr(10), 'g')"
    t = f"' ' || trim(regexp_replace({t}, {_sql(licenses.NOT_WORD)}, '  ', 'g')) || ' '"
    for other, usual in licenses.SPELLINGS:
        t = f"replace({t}, ' {other.replace(' ', '  ')} ', ' {usual.replace(' ', '  ')} ')"
    return f"regexp_replace(trim(regexp_replace({t}, ' +', ' ', 'g')), {_sql(licenses.title_pattern())}, '')"


def _license_sql() -> str:
    known = ", ".join(f"({_sql(k)}, {_sql(v)})" for k, v in licenses.KNOWN.items())
    return f"""with k as (select sha256({_canonical_sql('body')}) as h, min(split_part(id, '#', 1)) as license_id from (values {known}) t(id, body) group by 1),
d as (select doc_id, sha256({_canonical_sql('text')}) as canon_sha256 from documents)
select doc_id, canon_sha256, license_id from d left join k on h = canon_sha256"""


_MASK = """list_aggregate(list_transform(list_filter(range(1, len({s}) + 1), lambda i: {s}[i].role = 'assistant'),
 lambda i: (coalesce(list_sum(list_transform({s}[1:i - 1], lambda t: length(t.role) + length(t.text) + 13)), 0) + length({s}[i].role) + 5)::bigint::varchar || '-' ||
 (coalesce(list_sum(list_transform({s}[1:i], lambda t: length(t.role) + length(t.text) + 13)), 0) - 0)::bigint::varchar), 'string_agg', ',')"""
_RENDER = "coalesce(list_aggregate(list_transform({s}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), 'string_agg', ''), '')"

_FIELD = "coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)),
lambda s, b: list_reduce(list_prepend(xor(s, b), [1, 1, 1, 1, 1, 1, 1, 1]::bigint[]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))))"""
#: The tree of each group by levels: a node's place, the size of its level, its hash; then siblings by level, a step for each leaf and level.
_MERKLE = f"""with recursive d as (select row_number() over () as k, *, {_LEAF.format(n="n_chars")} as leaf, {_LEAF.format(n="(n_chars + case when " + _CRC + " % 7 = 0 then 1 else 0 end)")} as changed from documents),
a as (select k, doc_id, coalesce('=' || lang, '-') as g, leaf, changed, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from d),
t as (select 0 as level, g, i, n, leaf as h from a union all select level + 1, g, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from t where n > 1 group by level, g, i // 2, n),
s as (select g, h, row_number() over (order by g) - 1 as i, count(*) over () as n, max(level) over (partition by g) as height from t where n = 1),
u as (select 0 as level, i, n, h from s union all select level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from u where n > 1 group by level, i // 2, n),
p as (select a.k, t.level, (a.i >> t.level) & 1 as side, b.h from a join t on a.g = t.g and a.i >> t.level = t.i and t.n > 1 left join t b on b.g = t.g and b.level = t.level and b.i = xor(t.i, 1)
union all select a.k, s.height + u.level, (s.i >> u.level) & 1, b.h from a join s on a.g = s.g join u on s.i >> u.level = u.i and u.n > 1 left join u b on b.level = u.level and b.i = xor(u.i, 1)),
f as (select k, 0 as level, changed as h from a union all select f.k, f.level + 1, sha256(case when p.h is null then f.h when p.side = 1 then p.h || f.h else f.h || p.h end) from f join p on f.k = p.k and f.level = p.level),
e as (select k, arg_max(h, level) as h from f group by 1), q as (select k, sha256(coalesce(string_agg(h, '' order by level), '')) as proof_sha256 from p group by 1)
select doc_id, leaf, s.h as subroot, r.h as root, coalesce(proof_sha256, sha256('')) as proof_sha256, e.h as folded_root, e.h = r.h as verified
from a join s on a.g = s.g join (select h from u where n = 1) r on true join e on e.k = a.k left join q on q.k = a.k"""

ORACLES = {
    "op12_merkle_manifest": _MERKLE,
    "op3_quality_rules": f"""with d as (select row_number() over () as k, doc_id, source, coalesce(text, '') as text from documents),
w as (select k, doc_id, source, {WORDS} as w, text from d),
win as (select k, i, array_to_string(w[i:i + 7], ' ') as s from (select k, w, unnest(range(1, len(w) - 6)) as i from w where len(w) > 7)),
rep as (select k, i from (select k, i, count(*) over (partition by k, s) as c from win) where c > 1),
cov as (select k, count(distinct i + j) as n from rep, (select unnest(range(8)) as j) group by 1),
lines as (select k, x from (select k, unnest(string_split(text, chr(10))) as x from d) where regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
dup as (select k, count(*) - count(distinct x) as n from lines group by 1),
f as (select w.k, doc_id, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words
from w left join dup using (k) left join cov using (k)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f),
h as (select source, count(*) as n, count_if(base_failed) as fl from b group by 1),
m as (select count(*) as hosts, sum(n) as docs, sum(fl) / sum(n) as m, sum(fl * (fl / n)) / sum(n) as m2 from h),
r as (select m, case when m * (1 - m) > 1e-12 and docs > hosts then ((m2 - m * m) * docs / (m * (1 - m)) - hosts) / (docs - hosts) else 0.0 end as rho from m),
p as (select m, least(greatest(case when rho > 1e-12 then 1 / rho - 1 else 1000.0 end, 2.0), 1000.0) as a from r),
bad as (select source from h, p where (fl + m * a) / (n + a) > 0.5)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
not base_failed and not exists (select 1 from bad where bad.source is not distinct from b.source) as kept from b""",
    "op5_chat_formatting": f"""with t as (select conv_id >> 1 as pair_id, conv_id & 1 as side, conv_id, {{'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}} as t from conversations),
p as (select pair_id, min(conv_id) filter (side = 0) as chosen_id, min(conv_id) filter (side = 1) as rejected_id,
coalesce(list(t order by t) filter (side = 0), []) as c0, coalesce(list(t order by t) filter (side = 1), []) as r0 from t group by 1),
n as (select *, coalesce(list_filter(range(1, least(len(c0), len(r0)) + 1), lambda i: c0[i].role <> r0[i].role or c0[i].text <> r0[i].text)[1] - 1, least(len(c0), len(r0))) as k from p),
s as (select pair_id, chosen_id, rejected_id, cast(k as bigint) as n_prefix, len(c0) = k and len(r0) = k as identical, c0[1:k] as p, c0[k + 1:] as c, r0[k + 1:] as r from n)
select pair_id, chosen_id, rejected_id, n_prefix, identical, {_RENDER.format(s='p')} as prompt, {_RENDER.format(s='c')} as chosen, {_RENDER.format(s='r')} as rejected,
coalesce({_MASK.format(s='c')}, '') as chosen_mask, coalesce({_MASK.format(s='r')}, '') as rejected_mask from s""",
    "op6_license_scans": _license_sql(),
}
