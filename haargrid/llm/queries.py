"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haargrid.llm import bpe, bwt_dedup, embed_dedup, jaccard_join, langid, license_scan, line_dedup, media, merkle, packing, pii, spelling, token_counts
from haargrid.llm.rows import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir)).drop("scores", "masked")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(documents(spark, sf_dir)), ("doc_id", "n_bytes", "payload_bytes"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(documents(spark, sf_dir)).withColumn("removed", F.concat_ws(",", F.col("removed").cast("array<string>")))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.without_repeats(documents(spark, sf_dir)).drop("kept")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(license_scan.scan_documents(documents(spark, sf_dir)))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_token_counts, op2_packing, op3_language_id, op5_personal_data, op8_byte_bpe, op9_flac, op10_jaccard_join, op7_line_dedup, op6_near_vectors, op4_repeated_strings, op12_merkle_manifest, op11_license_scan, op13_spelling_variants)}
_COMPONENTS = """both_ as (select a, b from link union all select b, a from link),
reach as (select a as id, a as c from both_ union select both_.b, reach.c from reach join both_ on both_.a = reach.id),
component as (select id, min(c) as c from reach group by id)"""


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def _crc32(codes: str) -> str:
    """The crc32 of a list of bytes, which this engine has no function for."""
    step = f"xor(c >> 8, ({_crc_table()}::bigint[])[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({codes}, lambda c, b: {step}, 4294967295::bigint), 4294967295)"


#: Levels that the SQL of the manifest has: sources of up to 16 ** 5 documents, as many sources.
_LEVELS = 5


def _levels(name: str, start: str) -> str:
    """{name}0 .. {name}5: nodes (key, i, h, n) of trees of width 16 over ``start``; {name}_path: for each of its rows the siblings (l1, r1 ..) of each level."""
    side = lambda a, b: f"coalesce(string_agg(h, '') over (partition by key, i // 16 order by i rows between {a} and {b}), '')"
    out = [f"{name}0 as ({start})"]
    for k in range(1, _LEVELS + 1):
        grouped = f"max(n) > {16 ** (k - 1)}"
        out.append(f"{name}{k} as (select key, i // 16 as i, case when {grouped} then sha256(string_agg(h, '' order by i)) else max(h) end as h, max(n) as n from {name}{k - 1} group by key, i // 16)")
        out.append(f"{name}s{k} as (select key, i, n > {16 ** (k - 1)} as up{k}, {side('unbounded preceding', '1 preceding')} as l{k}, {side('1 following', 'unbounded following')} as r{k} from {name}{k - 1})")
    joins = " ".join(f"join {name}s{k} on {name}s{k}.key = {name}0.key and {name}s{k}.i = {name}0.i // {16 ** (k - 1)}" for k in range(1, _LEVELS + 1))
    columns = ", ".join(f"{c}{k}" for k in range(1, _LEVELS + 1) for c in ("up", "l", "r"))
    out.append(f"{name}_path as (select {name}0.*, {columns} from {name}0 {joins})")
    return ", ".join(out)


def _manifest() -> str:
    framed = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(framed, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    steps = range(1, _LEVELS + 1)
    proof = " || ".join(f"case when {p}.up{k} then {p}.l{k} || {p}.r{k} else '' end" for p in ("d", "s") for k in steps)
    # each level's folding is a table of its own, or the expression would double with each
    chain = [f"f0 as (select d.doc_id, d.h as leaf, s.h as subroot, coalesce(d.tampered, d.h) as f0, sha256({proof}) as proof_sha256, " + ", ".join(f"{p}.{c}{k} as {p}_{c}{k}" for p in ("d", "s") for k in steps for c in ("up", "l", "r")) + " from d_path d join s_path s on s.source_key = d.key)"]
    for i, (p, k) in enumerate((p, k) for p in ("d", "s") for k in steps):
        chain.append(f"f{i + 1} as (select * replace (case when {p}_up{k} then sha256({p}_l{k} || f0 || {p}_r{k}) else f0 end as f0) from f{i})")
    text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rank = "(row_number() over (partition by key order by {o}) - 1)::bigint as i, count(*) over (partition by key) as n"
    return (
        f"with leaf as (select doc_id, coalesce('=' || source, '') as key, {leaf('text')} as h, case when {_crc32('list_transform(string_split(doc_id::varchar, {e}), lambda x: ascii(x)::bigint)').format(e=chr(39) * 2)} % 5 = 0 then {leaf(text)} end as tampered from documents), "
        + _levels("d", "select *, " + rank.format(o="doc_id nulls first, h") + " from leaf")
        + f", {_levels('s', 'select *, ' + rank.format(o='source_key') + f' from (select distinct 0 as key, key as source_key, h from d{_LEVELS})')}, "
        + ", ".join(chain)
        + f" select doc_id, leaf, subroot, h as root, proof_sha256, f0 as folded_root, f0 = h as verified from f{2 * _LEVELS}, s{_LEVELS}"
    )


def _spelling() -> str:
    codes = "flatten(list_transform(string_split(doc_id::varchar || ':' || run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end))"
    return f"""with recursive t as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{5,}}')) as run from documents),
r as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from t group by all),
h as (select run, n, {_crc32(codes)} as h from r),
w as (select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from h),
v as (select word, sum(n)::bigint as n from w where length(word) >= 5 group by word having sum(n) >= 3),
cut as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select *, unnest(range(1, length(word) + 1)) as i from v)),
less as (select distinct cut.word, v.word as form, cut.n, v.n as form_n from cut join v on v.word = cut.rest),
pair as (select a.word, b.word as form, a.n, b.n as form_n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word != b.word union all select * from less union all select form, word, form_n, n from less),
best as (select word, n, form, form_n, count(*) over (partition by word) as n_near, row_number() over (partition by word order by form_n desc, form) as k from pair),
led as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when form_n >= 2 * v.n then form end as form, case when form_n >= 2 * v.n then form_n end as form_n from v left join best on best.word = v.word and k = 1),
walk as (select word, word as root, form as next from led union all select walk.word, walk.next, led.form from walk join led on led.word = walk.next)
select led.word, form, root, n, n_near, form_n from led join walk on walk.word = led.word and walk.next is null"""


#: Pairs by a self-join, components by recursion; the others are compared with libraries and plain versions in tests.
ORACLE_SQL: dict[str, str] = {
    "op10_jaccard_join": r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as a from documents),
s as (select distinct doc_id, sh from (select doc_id, unnest(case when len(a) >= 3 then list_transform(range(1, len(a) - 1), lambda i: array_to_string(a[i:i + 2], ' ')) when len(a) > 0 then [array_to_string(a, ' ')] else [] end) as sh from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.sh = y.sh and x.doc_id < y.doc_id group by all),
link as (select a, b from pair join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 90 * (na.n + nb.n - k)), """
    + _COMPONENTS
    + " select documents.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c, documents.doc_id) as component_id from documents left join n using (doc_id) left join component on id = documents.doc_id",
    "op6_near_vectors": """with recursive v as (select vec_id, label, embedding::double[] as x from embeddings where label is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0 and len(list_filter(embedding, lambda e: e != 0)) > 0),
link as (select p.vec_id as a, q.vec_id as b from v p join v q on p.label = q.label and p.vec_id < q.vec_id and len(p.x) = len(q.x) where list_cosine_similarity(p.x, q.x) >= 0.98), """
    + _COMPONENTS
    + """, degree as (select a as id, count(*) as n from both_ group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(c, vec_id) as component_id, vec_id = coalesce(c, vec_id) as kept from embeddings left join component on component.id = vec_id left join degree on degree.id = vec_id""",
    "op12_merkle_manifest": _manifest(),
    "op13_spelling_variants": _spelling(),
}
