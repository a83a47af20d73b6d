"""One query for each operator, over its whole table, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm import alignment, byte_bpe, decontaminate, exact_dedup, license_scan, lm_score, near_dedup, pii, quality, substring_dedup, token_counts, url_rules, whitening
from plumbline.llm.common import fold, read


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark, sf_dir):
    done = substring_dedup.substring_dedup(read(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return done.select(
        "doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op2_lm_score(spark, sf_dir):
    return lm_score.lm_scores(read(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


def op3_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.hit_words("spans").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op4_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(read(spark, sf_dir, "documents"), percent=85)


def op5_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2)
    model = quality.fit_quality(docs, labels)
    scored = quality.score_text(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (fold("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op6_token_counts(spark, sf_dir):
    counts = token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT)


def bpe_digests(docs):
    """n_tokens, ids_sha256 and decoded_sha256 of each row's ids and bytes."""
    import public_tokenizers

    done = byte_bpe.encode_and_decode(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_byte_bpe(spark, sf_dir):
    return bpe_digests(read(spark, sf_dir, "documents"))


def op8_pii(spark, sf_dir):
    found = pii.find_pii(read(spark, sf_dir, "documents"))
    text = {c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",") for c in ("base", "spans")}
    kinds = F.transform("base", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *count, F.sha2(text["base"], 256).alias("base_sha256"), text["spans"].alias("spans"))


def op9_url_rules(spark, sf_dir):
    return url_rules.url_verdicts(read(spark, sf_dir, "pages"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op11_whitening(spark, sf_dir):
    done = whitening.whitened_components(read(spark, sf_dir, "embeddings"))
    return done.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_license_scan(spark, sf_dir):
    return license_scan.license_labels(read(spark, sf_dir, "documents"))


def op13_alignment(spark, sf_dir):
    return alignment.link_counts(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_lm_score, op3_decontaminate, op4_near_dedup, op5_quality, op6_token_counts, op7_byte_bpe, op8_pii, op9_url_rules, op10_exact_dedup, op11_whitening, op12_license_scan, op13_alignment)}

ORACLES = {"op3_decontaminate": decontaminate.SQL, "op4_near_dedup": near_dedup.SQL, "op9_url_rules": url_rules.SQL, "op10_exact_dedup": exact_dedup.SQL, "op12_license_scan": license_scan.SQL}
