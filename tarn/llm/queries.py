"""The queries of this subpackage, each over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, line_dedup, substring_dedup, warc
from tarn.llm.common import shared_base, table
from tarn.llm.decontaminate import decontaminate, digest
from tarn.llm.exact_dedup import exact_dedup
from tarn.llm.jaccard_join import jaccard_join
from tarn.llm.language import language_id
from tarn.llm.lexical_search import lexical_search
from tarn.llm.licenses import document_files, license_scan
from tarn.llm.resampling import resample
from tarn.llm.token_counts import count_tokens
from tarn.llm.toxicity import toxicity


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), shingle=4, similarity=(85, 100))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("clauses")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, records = warc.archive(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no file names, so those that are a licence's own text are the licence files of their source."""
    found = license_scan(document_files(table(spark, sf_dir, "documents")), id_col="doc_id", own_texts=True)
    return found.select("doc_id", "license", F.round("score", 6).alias("score"), "basis", F.col("from_id").alias("from_doc_id"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_counts(table(spark, sf_dir, "documents")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents")).drop("spans")


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """Where the installed tokenizer package keeps a vocabulary, that of op8 if none is named."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.bpe_encode(table(spark, sf_dir, "documents"), vocabulary())
    return bpe.digest(bpe.bpe_decode(tokens, vocabulary()))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that every run counts all texts."""
    cache = f"{shared_base(spark)}/token-counts-{uuid.uuid4().hex}"
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), cache=cache)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_language_id": op7_language_id,
    "op8_bpe": op8_bpe,
    "op9_license_scan": op9_license_scan,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_resample": op12_resample,
    "op13_lexical_search": op13_lexical_search,
}

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": rf"""
with d as (select doc_id, regexp_extract_all(coalesce({_FOLD}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(coalesce({_FOLD}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
n as (select item_id, w, least(13, len(w)) k from b where len(w) > 0),
win as (select distinct item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') s
        from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) i from n)),
ks as (select distinct k from n),
occ as (select doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') s
        from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, ks where len(w) >= k)),
hit as (select doc_id, i, o.k, item_id from occ o join win on win.s = o.s and win.k = o.k),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from hit) group by 1),
items as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) s from hit group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join words using (doc_id) left join items using (doc_id)
""",
    "op4_warc": """
with p as (select page_id, coalesce(html, '') t from pages),
r as (select page_id, t, strlen(t) n, case when strlen(t) >= 1000 then max(page_id) over (partition by t) else page_id end m from p)
select page_id, n payload_bytes, sha1(t) payload_digest, case when m = page_id then 'response' else 'revisit' end record_type,
       case when m <> page_id then m end refers_to from r
""",
    "op5_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
win as (select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') s
        from (select doc_id, w, unnest(range(1, len(w) - 11)) i from d where len(w) >= 13)),
low as (select doc_id, i, min(doc_id) over (partition by s) m from win),
gone as (select distinct doc_id, unnest(range(i, i + 13)) p from low where m < doc_id),
lists as (select doc_id, list(p) g from gone group by 1)
select doc_id, len(w)::bigint n_words, coalesce(len(g), 0)::bigint n_removed,
       sha256(case when g is null then array_to_string(w, ' ') else coalesce(k, '') end) kept_sha256
from d left join lists using (doc_id)
left join (select doc_id, string_agg(x, ' ' order by i) k
           from (select doc_id, unnest(w) x, generate_subscripts(w, 1) i from d semi join lists using (doc_id)) u
           anti join gone on gone.doc_id = u.doc_id and gone.p = u.i group by 1) using (doc_id)
""",
    "op6_exact_dedup": f"""
with n as (select doc_id, {_FOLD.replace('text', "coalesce(text, '')")} t from documents)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id kept, text_sha256 from (
  select doc_id, max(doc_id) over w keep_id, count(*) over w group_size, sha256(t) text_sha256 from n window w as (partition by t))
""",
    "op10_line_dedup": """
with l as (select doc_id, source, x, i from (select doc_id, source, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) i from documents where text is not null)),
t as (select source, count(*) total from documents group by 1),
c as (select source, trim(x) k, count(distinct doc_id) n from l where trim(x) <> '' group by 1, 2),
bad as (select c.source, k from c join t on c.source is not distinct from t.source where n >= 2 and n > total * cast(0.02 as double)),
j as (select doc_id, x, i, b.k is not null gone from l left join bad b on l.source is not distinct from b.source and trim(x) = b.k),
g as (select doc_id, count(*)::bigint n_lines, count(*) filter (gone)::bigint n_dropped, string_agg(x, chr(10) order by i) filter (not gone) kept from j group by 1)
select doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_dropped, 0) n_dropped, sha256(coalesce(kept, '')) kept_sha256
from documents left join g using (doc_id)
""",
    "op13_lexical_search": rf"""
with d as (select doc_id, unnest(regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) t from documents),
c as (select doc_id, t, count(*) tf from d group by 1, 2),
l as (select doc_id, sum(tf)::bigint n from c group by 1),
a as (select count(*) docs, sum(n)::bigint total from l),
f as (select t, count(*) df from c group by 1),
q as (select item_id, t, count(*) r from (select item_id, unnest(regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) t from benchmark) group by 1, 2),
w as (select item_id, q.t, r * floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint w from q join f on q.t = f.t, a),
m as (select doc_id, 75 + (25 * n * docs) // total m from l, a),
s as (select item_id, c.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint score from w join c on c.t = w.t join m on m.doc_id = c.doc_id group by 1, 2)
select item_id, rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id)::int rank from s where score > 0) where rank <= 20
""",
}
