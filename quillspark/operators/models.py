"""Label models behind one interface, a rule model for use without weights, metrics, and recovery of model answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.answers import keywords_of, label_of, summary_of
from quillspark.operators.filters import needs_classification

# Cue phrases of the primary labels; stand-ins for a trained model, whose labels they do not reproduce.
CUES = {
    "The Innovator": ["novel", "we propose", "new theory", "new framework"], "The Evaluator": ["benchmark", "we compare", "comparative", "evaluation of"],
    "The Combiner": ["hybrid", "combine", "fusion", "integrating"], "The Analyst": ["we analyze", "analysis", "explain why", "understanding"],
    "The Synthesizer": ["survey", "review", "taxonomy", "literature"], "The Translator": ["adapt", "cross-domain", "transfer", "applied to"],
    "The Architect": ["pipeline", "end-to-end", "architecture", "system"], "The Resource Creator": ["dataset", "corpus", "toolkit", "library"],
}


def rule_label(text: Column) -> Column:
    """The label with most cues in a text, the first on ties; null if there is none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    held = [F.struct(sum(F.contains(low, F.lit(c)).cast("int") for c in v).alias("n"), F.lit(-k).alias("at"), F.lit(name).alias("label")) for k, (name, v) in enumerate(CUES.items())]
    best = F.array_max(F.array(*held))
    return F.when(best["n"] > 0, best["label"])


def predicted(df: DataFrame, predict: Callable[[], Callable], text: Column, labels: list[str], id_col: str = "ord") -> DataFrame:
    """(id, label, confidence): ``predict()`` is made once in each Python worker and maps a list of texts to logits; argmax and softmax in Arrow batches."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        model = predict()
        for b in batches:
            z = np.asarray(model(b["text"].tolist()), float)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            b["label"] = [labels[k] if k < len(labels) else "Unknown" for k in p.argmax(axis=1)]
            b["confidence"] = p.max(axis=1)
            yield b[["id", "label", "confidence"]]

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), text.alias("text")).mapInPandas(run, f"id {kind}, label string, confidence double")


def classified(papers: DataFrame, label: Column | None = None) -> DataFrame:
    """Papers with predicted_main_archetype where it was missing and there is an abstract; others stay."""
    label = rule_label(F.concat_ws(" ", "title", "abstract")) if label is None else label
    return papers.withColumn("predicted_main_archetype", F.when(needs_classification(), label).otherwise(F.col("predicted_main_archetype")))


def patched(papers: DataFrame, labels: DataFrame, key: Column) -> DataFrame:
    """Papers with labels (key, main, second) where given."""
    joined = papers.withColumn("__key", key).join(labels.select(F.col("key").alias("__key"), "main", "second"), "__key", "left")
    both = {"predicted_main_archetype": F.coalesce("main", "predicted_main_archetype"), "predicted_second_tier_archetype": F.coalesce("second", "predicted_second_tier_archetype")}
    return joined.withColumns(both).select(papers.columns)


def prepared(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows: texts joined to labels on row_index, unlabelled ones dropped, blank second labels as None."""
    rows = texts.join(labels, "row_index").where("main_archetype is not null")
    return rows.withColumn("second_tier_archetype", F.coalesce(F.nullif(F.trim("second_tier_archetype"), F.lit("")), F.lit("None")))


def stratified(rows: DataFrame, label: str, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Rows with held_out: a share of each label by hash of the key; labels with a single row are never held out."""
    n = rows.groupBy(label).agg(F.count("*").alias("__n"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(10_000)) / 10_000
    return rows.join(n, label).withColumn("held_out", (draw < share) & (F.col("__n") > 1)).drop("__n")


def metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(n, accuracy, weighted_f1) from the confusion counts."""
    c = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    by_t = c.groupBy("t").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)).alias("hit"))
    by_g = c.groupBy(F.col("g").alias("t")).agg(F.sum("n").alias("guessed"))
    rows = by_t.join(by_g, "t", "left").withColumn("f1", 2 * F.col("hit") / (F.col("support") + F.coalesce("guessed", F.lit(0))))
    return rows.agg(F.sum("support").alias("n"), (F.sum("hit") / F.sum("support")).alias("accuracy"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def two_heads(df: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """(accuracy_1, f1_1, accuracy_2, f1_2, accuracy, f1): ``metrics`` of two (truth, guess) pairs and their means."""
    both = [metrics(df, *pair).select(F.col("accuracy").alias(f"accuracy_{k}"), F.col("weighted_f1").alias(f"f1_{k}")) for k, pair in enumerate((first, second), 1)]
    rows = both[0].join(F.broadcast(both[1]), F.lit(True))  # one row each
    return rows.withColumns({x: (F.col(f"{x}_1") + F.col(f"{x}_2")) / 2 for x in ("accuracy", "f1")})


def classified_items(items: DataFrame, heads: dict[str, DataFrame], id_col: str = "id") -> DataFrame:
    """``items`` with a label and <label>_confidence for each head (id, label, confidence); blank abstracts have null labels and confidence 0.0, whatever the heads say."""
    out = items
    has = F.coalesce(F.trim("abstract"), F.lit("")) != ""
    for name, head in heads.items():
        out = out.join(head.select(F.col("id").alias(id_col), F.col("label").alias(name), F.col("confidence").alias(f"{name}_confidence")), id_col, "left")
        out = out.withColumns({name: F.when(has, F.col(name)), f"{name}_confidence": F.when(has, F.coalesce(f"{name}_confidence", F.lit(0.0))).otherwise(0.0)})
    return out


def encoded_labels(rows: DataFrame, label: str, labels: list[str], fallback: str = "None") -> DataFrame:
    """``rows`` with <label>_id: the place of the label in ``labels``; unknown ones take the place of ``fallback``, or 0."""
    known = F.array_position(F.lit(labels), F.coalesce(F.col(label), F.lit(fallback))) - 1
    other = labels.index(fallback) if fallback in labels else 0
    return rows.withColumn(f"{label}_id", F.when(known >= 0, known).otherwise(other).cast("int"))


def recovered(df: DataFrame, answer: str, id_col: str = "id") -> DataFrame:
    """(id, title, summary, keywords) out of model answers, in Arrow batches."""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            both = [summary_of(x) for x in b["answer"]]
            b["title"], b["summary"] = [t for t, _ in both], [s for _, s in both]
            b["keywords"] = [keywords_of(x) for x in b["answer"]]
            yield b[["id", "title", "summary", "keywords"]]

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(answer).alias("answer")).mapInPandas(run, f"id {kind}, title string, summary string, keywords array<string>")


def recovered_labels(df: DataFrame, answer: str, id_col: str = "row_index") -> DataFrame:
    """(row_index, main_archetype, second_tier_archetype, parse_error) out of model answers; the index is the row's own, whatever the answer says."""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            told = [label_of(x) for x in b["answer"]]
            for k, name in enumerate(("main_archetype", "second_tier_archetype", "parse_error")):
                b[name] = [x[k] for x in told]
            yield b.drop(columns="answer")

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("row_index"), F.col(answer).alias("answer"))
    return rows.mapInPandas(run, f"row_index {kind}, main_archetype string, second_tier_archetype string, parse_error string")


def enriched(papers: DataFrame, stars: DataFrame | None = None) -> DataFrame:
    """Papers with code and data signals: a repository address sets has_public_code and fills code_url; without one, null becomes false.

    stars: (url, stars), looked up once an address; absent ones count 0. has_dataset is set anew from the abstract.
    """
    from quillspark.functions.text import filled, has_dataset, repo_url

    rows = papers.withColumn("__url", repo_url("code_url", "abstract"))
    if stars is not None:
        rows = rows.join(stars.select(F.col("url").alias("__url"), F.col("stars").alias("__stars")).dropDuplicates(["__url"]), "__url", "left")
    else:
        rows = rows.withColumn("__stars", F.lit(None).cast("long"))
    has = F.col("__url").isNotNull()
    return rows.withColumns({
        "has_dataset": has_dataset("abstract"), "has_public_code": F.when(has, True).otherwise(F.coalesce("has_public_code", F.lit(False))),
        "code_url": F.coalesce(filled("code_url"), "__url"), "repo_stars": F.when(has, F.coalesce("__stars", F.lit(0))).otherwise(0).cast("long"),
    }).select(papers.columns)


def attached_bibtex(papers: DataFrame) -> DataFrame:
    from quillspark.functions.text import bibtex

    return papers.withColumn("bibtex", bibtex())
