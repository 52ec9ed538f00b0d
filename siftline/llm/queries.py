"""The operators' queries, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, language_id, licence_scan, mixing, near_dedup, ogg, quality, secret_scan, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: its ids, and whether the text decoded from them is the text itself."""
    docs = table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2("text", 256))
    back = bpe.decode(bpe.encode(docs, keep=("doc_id", "text_sha256")))
    return back.select("doc_id", "token_ids", "n_tokens", F.sha2("decoded", 256).eqNullSafe(F.col("text_sha256")).alias("round_trip"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.train())


def op6_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets of every document's Ogg file, the payload by its MD5."""
    packets = ogg.demux(ogg.media_of(table(spark, sf_dir, "documents")))
    return packets.selectExpr("media_id as doc_id", "serial", "codec", "packet", "header", "gap", "octet_length(payload) as n_bytes", "md5(payload) as payload_md5", "round(seconds, 6) as seconds")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log of every conversation, folded and rendered."""
    return chat.reconstruct(chat.log_of(table(spark, sf_dir, "conversations")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_bpe, op3_quality, op4_mixing, op5_url_filter, op6_ogg, op7_licence_scan, op8_language_id, op9_chat, op10_secret_scan)}

ORACLE: dict[str, str] = {
    "op6_ogg": """
        with d as (select doc_id, text, cast(ceil(length(text) / 1000.0) as bigint) as n from documents where text is not null),
        parts as (select doc_id, k, substring(text, 1000 * k + 1, 1000) as part from (select doc_id, text, unnest(range(n)) as k from d)),
        heads as (select * from (values
            (1, 'opus', 0, 19, '{opus0}'), (1, 'opus', 1, 16, '{opus1}'),
            (2, 'vorbis', 0, 30, '{vorbis0}'), (2, 'vorbis', 1, 16, '{vorbis1}'), (2, 'vorbis', 2, 7, '{vorbis2}')) as t(serial, codec, packet, n_bytes, payload_md5))
        select doc_id, serial, codec, packet, true as header, false as gap, n_bytes, payload_md5, cast(null as double) as seconds from d, heads
        union all
        select doc_id, 1, 'opus', k + 2, false, false, strlen(part), md5(part), round((960.0 * (k + 1) - 312) / 48000, 6) from parts
        union all
        select doc_id, 2, 'vorbis', k + 3, false, false, 32, md5(md5(part)), round(1024.0 * (k + 1) / 44100, 6) from parts
    """.format(**{f"{name}{i}": hashlib.md5(h).hexdigest() for name, heads in (("opus", ogg.OPUS_HEADERS), ("vorbis", ogg.VORBIS_HEADERS)) for i, h in enumerate(heads)}),
    "op9_chat": """
        select conv_id, cast(count(*) as integer) as n_messages,
            string_agg('<|' || coalesce(role, 'user') || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' order by turn) as chat
        from conversations where conv_id is not null and turn is not null and text is not null group by conv_id
    """,
}
