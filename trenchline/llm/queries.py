"""Registered queries of the llm operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trenchline.llm.common import table
from trenchline.llm.oracles import ORACLE  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_harmonic_packing(spark, sf_dir):
    """All documents packed into 4096-token sequences; one row per piece."""
    from trenchline.llm.packing import packed_digest

    return packed_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register
def op9_doubling_dedup(spark, sf_dir):
    """Words in 35-word windows that start twice in the corpus, removed."""
    from trenchline.llm.doubling_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register
def op10_simple8b_files(spark, sf_dir):
    """Token ids of all documents through Simple-8b files and back."""
    from trenchline.llm.simple8b import decoded_digest, read_token_files, write_token_files
    from trenchline.session import scratch_path

    path = scratch_path(spark, "token_files")
    write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return decoded_digest(read_token_files(spark, path))


@register
def op4_decision_list(spark, sf_dir):
    """Text statistics and the verdict of the learned rules for all documents."""
    from trenchline.llm.decision_list import quality_verdicts

    out = quality_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register
def op5_minhash_join(spark, sf_dir):
    """Near-duplicate class and number of links of every document (five-word shingles, 0.8)."""
    from trenchline.llm.jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


@register
def op6_spotsigs(spark, sf_dir):
    """SpotSigs fingerprints of all documents and their edited texts."""
    from trenchline.llm.spotsigs import fingerprint_with_edits

    return fingerprint_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register
def op7_toxic_crf(spark, sf_dir):
    """Toxicity score of all documents, learned outside the held-out fold."""
    from trenchline.llm.toxic_crf import held_out, toxicity

    out = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


@register
def op2_elias_fano_lm(spark, sf_dir):
    """Language-model scores of all documents from sharded Elias-Fano trigram tries."""
    from trenchline.llm.ngram_trie import score_documents

    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register
def op8_gumbel_pieces(spark, sf_dir):
    """Two distinct sampled segmentations of every document, coded and decoded."""
    from trenchline.llm.gumbel_pieces import sample_segmentations

    out = sample_segmentations(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", F.crc32("ids").alias("ids_crc32"), "decodes")


@register
def op3_boosted_html(spark, sf_dir):
    """Main text of all pages."""
    from trenchline.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@register
def op11_bitmap_merkle(spark, sf_dir):
    """Merkle proofs of all documents, and the root folded again from tampered ones."""
    from trenchline.llm.merkle import LEAF_COLUMNS, fold, leaf_digest, merkle_manifest, proof

    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = leaf_digest([lowered if c == "text" else F.col(c) for c in LEAF_COLUMNS])
    touched = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = table(spark, sf_dir, "documents").select(*LEAF_COLUMNS)
    out = merkle_manifest(docs, carry={"changed": F.when(touched, tampered)})
    folded = out.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@register
def op12_reply_trees(spark, sf_dir):
    """All conversations and one that is full of control strings, formatted and read back."""
    from trenchline.llm.common import landed
    from trenchline.llm.reply_trees import format_paths, read_digests, reply_paths, turn_chain

    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    nodes, messages = turn_chain(rows.unionByName(more))
    steps = reply_paths(nodes.select("tree", "id", "parent", "score"), branches=1)
    steps = steps.join(nodes.select("tree", "id", "turn", "digest"), ["tree", "id"]).drop("id")
    formatted = landed(format_paths(messages, steps, ["tree", "turn", "digest"]), "formatted")
    conv = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).cast("long")
    return read_digests(formatted).select(conv.alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@register
def op13_l2ap_negatives(spark, sf_dir):
    """The first hard negatives below every positive of every 50th vector."""
    from trenchline.llm.hard_negatives import hard_negatives

    vec_id = F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=label, anchors=vec_id % 50 == 0)
