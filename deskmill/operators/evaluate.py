"""Answer scoring: rules, then similarity, then a judge; statistics by file and over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.config import EVALUATION_THRESHOLD
from deskmill.functions import text as T

YES, NO, ERROR, SKIPPED = "Да", "Нет", "Ошибка", "Пропуск"


def has_error(answer: Column) -> Column:
    return F.array_contains(F.transform(F.array(*[F.lit(m) for m in T.ERROR_MARKERS]), lambda m: F.contains(answer, m)), True)


def missing_parts(answer: Column, reference: Column) -> Column:
    """Normalised parts of the reference that the normalised answer doesn't contain."""
    parts = F.filter(F.transform(T.reference_parts(reference), T.normalize_answer), lambda x: x != "")
    return F.filter(parts, lambda p: ~F.contains(T.normalize_answer(answer), p))


def cascade(rows: DataFrame, answer: str, reference: str, similarity: Column | None = None, threshold: float = EVALUATION_THRESHOLD, judge: Column | None = None) -> DataFrame:
    """``rows`` with ``verdict``, ``score`` and ``rule``; the first rule that applies decides.

    blank, error mark, option letters, all parts, equal, contained, similarity over the threshold, judge, else no.
    """
    a, r = F.col(answer), F.col(reference)
    na, nr = T.normalize_answer(a), T.normalize_answer(r)
    la, lr = T.option_letters(a), T.option_letters(r)
    parts = F.filter(F.transform(T.reference_parts(r), T.normalize_answer), lambda x: x != "")
    both = (na != "") & (nr != "")
    similarity = similarity if similarity is not None else F.lit(None).cast("double")
    judge = judge if judge is not None else F.lit(None).cast("boolean")
    similar = F.round(F.coalesce(similarity, F.lit(0.0)), 4)
    cases = [
        (~T.present(a) | ~T.present(r), "blank", F.lit(None).cast("boolean"), F.lit(None).cast("double")),
        (has_error(a), "error", F.lit(None).cast("boolean"), F.lit(0.0)),
        (both & (F.size(la) > 0) & (F.size(lr) > 0), "letters", la == lr, None),
        (both & (F.size(parts) > 1), "parts", F.size(F.filter(parts, lambda p: ~F.contains(na, p))) == 0, None),
        (both & (na == nr), "equal", F.lit(True), None),
        (both & F.contains(na, nr), "contained", F.lit(True), None),
        (F.coalesce(similarity, F.lit(0.0)) >= threshold, "similar", F.lit(True), similar),
        (judge.isNotNull(), "judge", judge, similar),
    ]
    rule, right, score = F.lit("none"), F.lit(False), similar
    for condition, name, holds, value in reversed(cases):
        rule = F.when(condition, name).otherwise(rule)
        right = F.when(condition, holds).otherwise(right)
        score = F.when(condition, value if value is not None else F.when(holds, 1.0).otherwise(0.0)).otherwise(score)
    out = rows.withColumn("rule", rule).withColumn("_right", right).withColumn("score", score)
    verdict = F.when(F.col("rule") == "blank", SKIPPED).when(F.col("rule") == "error", ERROR).when(F.col("_right"), YES).otherwise(NO)
    return out.withColumn("verdict", verdict).drop("_right")


def statistics(judged: DataFrame, file: str = "file") -> DataFrame:
    """Counts and accuracy of each file, and of all as file null: skipped rows don't count, errors do; none without rows."""
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    rows = judged.rollup(file).agg(F.count_if(F.col("verdict") != SKIPPED).alias("total"), is_(YES).alias("correct"), is_(NO).alias("incorrect"), is_(ERROR).alias("errors"), is_(SKIPPED).alias("skipped"), F.grouping(file).cast("int").alias("all_files"))
    accuracy = F.when(F.col("total") > 0, F.round(F.col("correct") / F.col("total") * 100, 1)).otherwise(0.0)
    return rows.withColumn("accuracy", accuracy)


def pending(items: DataFrame, done: DataFrame, key: str, answer: str) -> DataFrame:
    """Items without a usable answer: blank and error answers are asked again."""
    usable = T.present(answer) & ~F.startswith(F.col(answer), F.lit(T.ERROR_MARKERS[0]))
    return items.join(done.filter(usable).select(key), key, "left_anti")
