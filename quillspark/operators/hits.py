"""What surrounds a ranked list: classification of text hits, fusions, model hooks and context levels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import within_budget

#: What a hit gains by the kind of its symbol.
LABEL_BONUS = {"function": 0.3, "method": 0.3, "class": 0.25, "interface": 0.2, "type": 0.15, "component": 0.3, "hook": 0.3, "constant": 0.1}


def classified(hits: DataFrame, symbols: DataFrame, centrality: DataFrame) -> DataFrame:
    """``(file, line, text, symbol, score)``: each hit with the smallest symbol around it, two different lines a symbol at most.

    Score: half the file's centrality, the kind's bonus, and 0.3 for each hit of the symbol; 0 without a symbol.
    """
    s = symbols.select(F.col("file").alias("sf"), F.col("id").alias("symbol"), "kind", "start_line", "end_line")
    inside = (F.col("file") == F.col("sf")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    span = F.struct(F.coalesce(F.col("end_line") - F.col("start_line"), F.lit(1 << 30)), "symbol")
    owned = hits.join(s, inside, "left").groupBy("file", "line", "text").agg(F.min_by(F.struct("symbol", "kind"), span).alias("s")).select("file", "line", "text", "s.symbol", "s.kind")
    counted = owned.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("symbol is not null")
    same = Window.partitionBy("symbol", "text").orderBy("file", "line")
    order = Window.partitionBy("symbol").orderBy("copy", "file", "line")
    # hits without a symbol would be one hot key of the windows
    within = owned.where("symbol is not null").withColumn("copy", F.row_number().over(same)).withColumn("place", F.row_number().over(order)).where("place <= 2")
    kept = within.drop("copy", "place").unionByName(owned.where("symbol is null"))
    bonus = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABEL_BONUS.items() for x in kv]), F.col("kind")), F.lit(0.0))
    full = kept.join(counted, "symbol", "left").join(centrality.select("file", "centrality"), "file", "left")
    score = F.when(F.col("symbol").isNull(), 0.0).otherwise(0.5 * F.coalesce("centrality", F.lit(0.0)) + bonus + 0.3 * F.col("n"))
    return full.select("file", "line", "text", "symbol", score.alias("score"))


def chunk_fusion(semantic: DataFrame, hits: DataFrame, chunks: DataFrame, constant: int = 60) -> DataFrame:
    """``(id, score)``: reciprocal ranks of chunks ``(id, rank)`` and of text hits ``(file, line, rank)`` in the one chunk that begins last before them."""
    c = chunks.select("id", F.col("file").alias("cf"), "start_line", "end_line")
    inside = (F.col("file") == F.col("cf")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    placed = hits.join(c, inside).groupBy("file", "line", "rank").agg(F.max_by("id", F.struct("start_line", "id")).alias("id")).select("id", "rank")
    return semantic.select("id", "rank").unionByName(placed).groupBy("id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))


def conversation_fusion(lexical: DataFrame, semantic: DataFrame, key: str) -> DataFrame:
    """``(key, score)``: lexical + 0.2 semantic of the best lexical score, and 0.15 of it for turns without lexical score."""
    top = lexical.agg(F.coalesce(F.max("score"), F.lit(1.0)).alias("top"))
    both = lexical.select(key, F.col("score").alias("l")).join(semantic.select(key, F.col("score").alias("s")), key, "full_outer").crossJoin(F.broadcast(top))
    return both.select(key, F.when(F.col("l").isNull(), F.col("s") * F.col("top") * 0.15).otherwise(F.col("l") + F.coalesce("s", F.lit(0.0)) * F.col("top") * 0.2).alias("score"))


def reranked(best: DataFrame, scorer: Callable[[pd.Series], pd.Series] | None, text: str, score: str, key: str, most: int = 50) -> DataFrame:
    """The first ``most`` rows in the order of a caller's model, the others behind them; unchanged without a model."""
    place = F.row_number().over(Window.orderBy(F.col(score).desc(), key))
    listed = best.withColumn("place", place)
    if scorer is None:
        return listed
    model = F.pandas_udf(scorer, "double")
    order = Window.orderBy(F.col("place") > most, F.col("model").desc_nulls_last(), "place")
    return listed.withColumn("model", F.when(F.col("place") <= most, model(F.col(text)))).withColumn("place", F.row_number().over(order)).drop("model")


def static_embedding(vocabulary: dict[str, int], matrix: np.ndarray) -> Callable[[Column], Column]:
    """A Column function: greedy longest subwords (``##`` inside words), the mean of their rows, normalised; zero stays zero."""
    import re
    import unicodedata

    words = re.compile(r"\w+|[^\w\s]")

    def pieces(word: str) -> list[int]:
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                i = vocabulary.get(("##" if at else "") + word[at:end])
                if i is not None:
                    out.append(i)
                    at = end
                    break
            else:
                return out
        return out

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            ids = [i for w in words.findall(unicodedata.normalize("NFC", t or "").lower()) for i in pieces(w)]
            v = matrix[ids].mean(0) if ids else np.zeros(matrix.shape[1])
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(float).tolist())
        return pd.Series(out)

    return F.pandas_udf(run, "array<double>")


def context(level: int, ranked: DataFrame, budget: int) -> DataFrame:
    """Ranked symbols ``(id, file, kind, name, source, score)`` at level 0 (sources), 1 (names), 2 (files) or 3 (directories), within a token budget."""
    if level == 0:
        rows = ranked.select(F.col("id").alias("key"), F.col("source").alias("text"), "score")
    elif level == 1:
        rows = ranked.select(F.col("id").alias("key"), F.concat_ws(" ", "kind", "name", "file").alias("text"), "score")
    else:
        key = F.col("file") if level == 2 else F.regexp_replace("file", "/?[^/]*$", "")
        rows = ranked.groupBy(key.alias("key")).agg(F.max("score").alias("score"), F.concat_ws(" ", F.array_sort(F.collect_set("name"))).alias("text"))
    priced = rows.withColumn("cost", F.greatest(F.ceil(F.length(F.coalesce("text", F.lit(""))) / 3.5), F.lit(1)))
    return within_budget(priced, budget, "cost", F.col("score").desc(), F.col("key"))


def suggestions(symbols: DataFrame, name: str, k: int = 5) -> DataFrame:
    """The k names nearest to one that is unknown, by edit distance without case."""
    near = symbols.select("name").distinct().withColumn("distance", F.levenshtein(F.lower("name"), F.lit(name.lower())))
    return near.orderBy("distance", "name").limit(k)
