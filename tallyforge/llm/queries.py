"""The registered query of each operator of this subpackage, and its SQL where there is one."""

from __future__ import annotations

import base64
import hashlib
import uuid

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.block_knn import nearest
from tallyforge.llm.bpe_codec import encode_decode
from tallyforge.llm.common import cut, remove, shared_folder, table
from tallyforge.llm.conversations import damaged, repair_conversations, with_all
from tallyforge.llm.divergence import divergence_audit
from tallyforge.llm.fingerprints import fingerprint_documents
from tallyforge.llm.graph_dedup import vector_duplicates
from tallyforge.llm.minhash_dedup import near_duplicates
from tallyforge.llm.mixing import mix_sources
from tallyforge.llm.pii import find_personal_data
from tallyforge.llm.prefix_tokens import prefix_token_counts
from tallyforge.llm.quality import score_quality
from tallyforge.llm.toxicity import score, train
from tallyforge.llm.warc import read_warc, write_warc

WORD_BPE = "word_bpe_49k.json"


def op1_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def _as_read(batches):
    """Sizes and digests of responses, from the payloads that were read; they must be as told."""
    for batch in batches:
        size, digest = batch.column("payload_bytes").to_pylist(), batch.column("payload_digest").to_pylist()
        for k, (kind, body) in enumerate(zip(batch.column("record_type").to_pylist(), batch.column("payload").to_pylist())):
            if kind == "response":
                own = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
                if own != (size[k], digest[k]):
                    raise ValueError(f"a payload differs from its headers: {own}, {size[k], digest[k]}")
                size[k], digest[k] = own
        names = [n for n in batch.schema.names if n != "payload"]
        held = {"payload_bytes": pa.array(size, pa.int64()), "payload_digest": pa.array(digest, pa.string())}
        yield pa.RecordBatch.from_arrays([held.get(n, batch.column(n)) for n in names], names=names)


def op2_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives, then reads every record's payload back: size and digest of a response
    are those of the bytes read, a revisit's are those of its response."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), folder, least_bytes=0)
    read = read_warc(spark, folder).where("record_type in ('response', 'revisit')")
    told = read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload")
    out = cut(told.mapInArrow(_as_read, told.drop("payload").schema))
    remove(spark, folder)
    return out


def op3_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return prefix_token_counts(docs, public_tokenizers.path(WORD_BPE), limit=2048)


def op4_co_trained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_graph_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op8_block_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode_decode(docs, public_tokenizers.path(WORD_BPE), outputs=("ids_sha256", "decoded_sha256"))


def op10_information_theoretic_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents"), least_docs=10, top=10)


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return with_all(repair_conversations(damaged(rows)), rows)


QUERIES = {
    "op1_string_kernel_toxicity": op1_string_kernel_toxicity,
    "op2_warc_source": op2_warc_source,
    "op3_prefix_token_counts": op3_prefix_token_counts,
    "op4_co_trained_quality": op4_co_trained_quality,
    "op5_graph_near_dedup": op5_graph_near_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_block_nearest": op8_block_nearest,
    "op9_bpe_encode_decode": op9_bpe_encode_decode,
    "op10_information_theoretic_pii": op10_information_theoretic_pii,
    "op11_source_divergence": op11_source_divergence,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_conversation_repair": op13_conversation_repair,
}
_COMPONENTS = """
        reach(node, root) as (
            select id, id from nodes
            union
            select links.b, reach.root from reach join links on links.a = reach.node where links.b > reach.root
        ), found as (select node, min(root) as component from reach group by node)
"""
_USABLE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"

ORACLE_SQL: dict[str, str] = {
    "op5_graph_near_dedup": f"""
        with recursive v as (
            select vec_id as id, label, embedding::double[] as e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x))) as len
            from embeddings where label is not null and {_USABLE}
        ), links as materialized (
            select v.id as a, w.id as b from v join v as w on v.label = w.label and v.id <> w.id
            where list_dot_product(v.e, w.e) / (v.len * w.len) >= 0.93
        ), nodes as (select vec_id as id from embeddings), {_COMPONENTS}
        select vec_id, coalesce(n, 0) as n_links, component as component_id, vec_id = component as kept
        from embeddings join found on node = vec_id left join (select a, count(*) as n from links group by a) on a = vec_id
    """,
    "op7_minhash_near_dedup": f"""
        with recursive w as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x20\\x09-\\x0D]+') as words from documents
        ), s as materialized (
            select doc_id, list_distinct(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
                else list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' ')) end) as items from w
        ), i as materialized (select doc_id, len(items) as n, unnest(items) as item from s),
        links as materialized (
            select x.doc_id as a, y.doc_id as b from i as x join i as y on x.item = y.item and x.doc_id <> y.doc_id
            group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))
        ), nodes as (select doc_id as id from documents), {_COMPONENTS}
        select doc_id, len(items) as n_shingles, component as component_id, doc_id = component as kept from s join found on node = doc_id
    """,
    "op8_block_nearest": f"""
        with v as (select vec_id, embedding::double[] as e from embeddings where {_USABLE}),
        d as (
            select q.vec_id as query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) as score
            from v as q join v as c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)
        )
        select query_id, row_number() over (partition by query_id order by score, vec_id)::int as rank, vec_id, score
        from d qualify rank <= 10
    """,
    "op11_source_divergence": """
        with d as (
            select coalesce(lang, '') as lang, coalesce(source, '') as source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as words from documents
        ), g as (select distinct lang, source from d),
        n as (select lang, source, term, count(*)::hugeint as n from (select lang, source, unnest(words) as term from d) group by all),
        kept as (select lang, term from (select lang, unnest(list_distinct(words)) as term from d) group by all having count(*) >= 10),
        v as (select lang, count(*)::hugeint as v from kept group by lang),
        c as (
            select g.lang, g.source, term, coalesce(n.n, 0)::hugeint as n from g join kept using (lang) left join n using (lang, source, term)
            union all select lang, null, term, sum(n)::hugeint from n semi join kept using (lang, term) group by lang, term
        ), p as materialized (
            select lang, source, term, n, 1 + 1000000000 * (n + 2) // (sum(n) over (partition by lang, source) + 2 * v)::hugeint as p from c join v using (lang)
        ), pair as (
            select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
            from p as a join p as b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
        ), term as (
            select a.lang, a.source, a.term as item, (a.p - q.p) * (a.p - q.p) // (a.p + q.p) as value
            from p as a join p as q on a.lang = q.lang and a.term = q.term and q.source is null where a.n > 0 and a.p > q.p
        ), u as (
            select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
            from g as a join g as b on a.lang = b.lang and a.source <> b.source left join pair on pair.lang = a.lang and pair.source = a.source and item = b.source
            union all select lang, source, 'term', item, value from term
        )
        select lang, source, part, item, value::bigint as value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
        from u qualify part = 'pair' or rank <= 10
    """,
    "op2_warc_source": """
        with p as (
            select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h, trim(url) as target_uri from pages
        ), b as (
            select *, list_aggregate(list_transform(range(0, 40), lambda i: substr(
                '0000000100100011010001010110011110001001101010111100110111101111',
                1 + 4 * (strpos('0123456789abcdef', substr(h, (i + 1)::int, 1)) - 1), 4)), 'string_agg', '') as bits,
                min(page_id) over (partition by h, payload_bytes) as first
            from p
        )
        select page_id, payload_bytes,
            list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
                16 * substr(bits, (5 * i + 1)::int, 1)::int + 8 * substr(bits, (5 * i + 2)::int, 1)::int +
                4 * substr(bits, (5 * i + 3)::int, 1)::int + 2 * substr(bits, (5 * i + 4)::int, 1)::int +
                substr(bits, (5 * i + 5)::int, 1)::int, 1)), 'string_agg', '') as payload_digest,
            case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
            case when page_id is distinct from first then first end as refers_to, target_uri
        from b
    """,
}
