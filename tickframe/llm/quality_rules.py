"""Document quality as a ledger of rule bits.

``ledger`` evaluates every rule once and keeps the measurements and one bit per failed rule. Policies
are named sets of rules; ``apply_policy`` compares the bits with a policy's mask and reads no text.
``ablation`` tells, per policy and rule, what the rule rejects and what it alone rejects, from counts of equal
bit patterns. Built-in SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Rules in bit order: name and the failing condition over the measurements. Bits keep their
# meaning for ever; new rules go to the end.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "4 * n_symbols > n_words"),
    ("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 30 * n_words"),
    ("shouting", "n_words >= 10 AND 2 * n_capitals > word_chars"),
    ("exclaiming", "n_words >= 10 AND 2 * n_marks > n_words"),
]
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "v1": [name for name, _ in RULES],
}
POLICY = "v1"


def mask(policy: str) -> int:
    bit = {name: 1 << k for k, (name, _) in enumerate(RULES)}
    return sum(bit[name] for name in POLICIES[policy])


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _measured(df: DataFrame) -> DataFrame:
    """Adds the measurements that need no window of words, and the words and lines themselves."""
    text = F.col("_text")
    plain = _without(text, SPACES)
    lines = F.filter(F.split(text, "\n", -1), lambda s: F.length(_without(s, SPACES)) > 0)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: F.length(w) > 0)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
    return (df.withColumn("_words", words).withColumn("_lines", lines)
            .withColumn("n_words", F.size("_words").cast("long"))
            .withColumn("word_chars", F.length(plain).cast("long"))
            .withColumn("n_symbols", (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"))
            .withColumn("n_capitals", (F.length(text) - F.length(_without(text, capitals))).cast("long"))
            .withColumn("n_marks", (F.length(text) - F.length(_without(text, "!"))).cast("long"))
            .withColumn("n_lines", F.size("_lines").cast("long"))
            .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")))


def _windows(words: Column, join: bool) -> Column:
    """Every run of five words, as text or as a hash of it; none in shorter texts."""
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)))
    # A line feed cannot lie in a word, so joined windows are equal only if their words are.
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, WINDOW), "\n") if join
                       else F.xxhash64(F.slice(words, i, WINDOW)))


def ledger(docs: DataFrame, *carried: Column) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, measurements and ``failed_rules`` (bits in rule order).

    A null text has no words; a null ``doc_id`` stays null; repeated rows give repeated rows; other columns
    are ignored, except those in ``carried``. Words are runs of characters other than space and U+0009-U+000D.

    Words in repeated windows: a text whose windows all have different hashes has none. In the others the
    windows themselves are sorted with their places, and each repeated one adds the words that the
    next repeated one does not cover.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), *carried)
    names = base.columns[2:]
    df = _measured(base).withColumn("_hashes", _windows(F.col("_words"), join=False))
    repeats = F.coalesce(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.lit(False))
    sorted_windows = F.sort_array(F.transform(_windows(F.col("_words"), join=True),
                                              lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(repeats, sorted_windows))
    # Neighbours as arrays of their own: an element equal to the one before or after it is repeated.
    shift = F.struct(F.lit("").alias("w"), F.lit(-1).alias("i"))
    before = F.concat(F.array(shift), F.slice("_sorted", F.lit(1), F.size("_sorted") - 1))
    after = F.concat(F.slice("_sorted", F.lit(2), F.size("_sorted") - 1), F.array(shift))
    zipped = F.arrays_zip(F.col("_sorted").alias("s"), before.alias("b"), after.alias("a"))
    places = F.sort_array(F.transform(
        F.filter(zipped, lambda z: (z["s"]["w"] == z["b"]["w"]) | (z["s"]["w"] == z["a"]["w"])), lambda z: z["s"]["i"]))
    df = df.withColumn("_places", F.when(F.col("_sorted").isNotNull(), places))
    following = F.concat(F.slice("_places", F.lit(2), F.greatest(F.size("_places") - 1, F.lit(0))), F.array(F.lit(2147483647)))
    covered = F.aggregate(F.arrays_zip(F.col("_places").alias("p"), following.alias("n")), F.lit(0).cast("long"),
                          lambda total, z: total + F.least(F.lit(WINDOW), z["n"] - z["p"]).cast("long"))
    df = df.withColumn("n_repeat_words", F.when(F.size("_places") > 0, covered).otherwise(F.lit(0).cast("long")))
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, condition) in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return df.withColumn("failed_rules", total).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks",
        "failed_rules", *names)


def accepted(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, columns as they were."""
    judged = apply_policy(ledger(docs, F.struct("*").alias("_row")), policy)
    # A filter on a column that is no function of the others stays above the measurements. Pushed below them it
    # would repeat their expressions many times over.
    return judged.withColumn("_place", F.monotonically_increasing_id()).where("kept AND _place >= 0").select("_row.*")


def apply_policy(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """Adds ``policy``, ``base_failed`` and ``kept`` to ledger rows. ``base_failed`` always rejects."""
    failed = F.col("failed_rules")
    return (rows.withColumn("policy", F.lit(policy))
            .withColumn("base_failed", failed.bitwiseAND(F.lit(mask("base"))) != 0)
            .withColumn("kept", failed.bitwiseAND(F.lit(mask("base") | mask(policy))) == 0))


def ablation(rows: DataFrame) -> DataFrame:
    """``policy, rule, rejected, alone``: documents that fail a rule of a policy, and those that fail no other of it.

    The ledger is reduced to counts per bit pattern first, of which there are few.
    """
    patterns = rows.groupBy("failed_rules").agg(F.count(F.lit(1)).alias("n"))
    checks = [(policy, name, 1 << k, mask(policy)) for policy in POLICIES
              for k, (name, _) in enumerate(RULES) if name in POLICIES[policy]]
    rules = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit"),
                               F.lit(m).cast("long").alias("mask")) for p, r, b, m in checks])
    each = patterns.select("failed_rules", "n", F.explode(rules).alias("c")).select("failed_rules", "n", "c.*")
    failed = F.col("failed_rules").bitwiseAND(F.col("mask"))
    hit = failed.bitwiseAND(F.col("bit")) != 0
    return each.groupBy("policy", "rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(failed == F.col("bit"), F.col("n")).otherwise(0)).alias("alone"))
