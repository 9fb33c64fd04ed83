"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Each rule says good, bad or nothing about a document. A document is of one of two hidden kinds, and each kind draws each
vote of a rule, abstentions too, with a chance of its own. Expectation-maximisation over the counts of vote patterns (at
most 3 to the number of rules, whatever the corpus) estimates these chances and the share of good documents freely: the
prior is ten made-up documents of each kind. The kind that draws fewer bad votes is the good one; nothing else sets the
kinds apart, so a rule whose bad votes come as often from either kind counts for nothing, and rules that agree count for
much. The documents that fail the base figures teach nothing, as they are out in any case. A document is kept if it
passes those and its posterior probability of being good is at least one half. Everything that touches documents is
DataFrame expressions; only the pattern counts reach the driver.

Null and empty texts have no words and fail the base rule. Repeated rows are judged alike, a posterior of exactly one half
keeps, an empty table gives an empty one, and only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: name: (the document looks bad, the document looks good); otherwise the rule abstains.
RULES = {
    "symbols": ("100 * n_symbols > 10 * n_words", "100 * n_symbols <= 2 * n_words"),
    "letters": ("100 * n_letters < 90 * word_chars", "100 * n_letters >= 95 * word_chars"),
    "word_length": ("word_chars > 8 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 7 * n_words"),
    "repeats": ("100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    "lines": ("n_lines > 3 and 100 * n_dup_lines > 50 * n_lines", "100 * n_dup_lines <= 5 * n_lines"),
    "capitals": ("100 * n_capitals > 40 * word_chars", "100 * n_capitals <= 15 * word_chars"),
    "shouts": ("100 * n_shouts > 30 * n_words", "100 * n_shouts <= 8 * n_words"),
}
#: Made-up documents (good, bad) behind each vote and each kind before any is seen: a rule is somewhat better than chance.
PRIOR = {1: (7.0, 4.0), 0: (2.0, 2.0), -1: (1.0, 4.0)}
FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
WHITE = r"[\x20\x09-\x0D]"


def measures(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The base figures of each text, and those that the rules need, by expressions over the text's own row.

    explode(array(...)) keeps the words, and what is made of them, as values: inside a lambda an expression would be
    worked out anew for each element. Windows of three words are compared by 64-bit hash within one text.
    """
    df = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    split = f"array_remove(split(text, r'{WHITE}+'), '')"
    lines = rf"filter(split(text, '\n'), x -> x rlike r'[^\x20\x09-\x0D]')"
    df = df.selectExpr("id", "text", f"explode(array({split})) words", f"{lines} lines")
    df = df.selectExpr(
        "id",
        "words",
        "cast(size(words) as bigint) n_words",
        "cast(length(array_join(words, '')) as bigint) word_chars",
        r"cast(regexp_count(text, r'[#*$%&|<>]') as bigint) n_symbols",
        "cast(size(lines) as bigint) n_lines",
        "cast(size(lines) - size(array_distinct(lines)) as bigint) n_dup_lines",
        r"cast(length(regexp_replace(text, r'[^\p{L}\p{M}]+', '')) as bigint) n_letters",
        r"cast(length(regexp_replace(text, r'\P{Lu}+', '')) as bigint) n_capitals",
        "cast(length(text) - length(replace(text, '!', '')) as bigint) n_shouts",
    )
    figures = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_letters", "n_capitals", "n_shouts"]
    window = "struct(xxhash64(x, get(words, i + 1), get(words, i + 2)) as h, i as p)"
    df = df.selectExpr("id", *figures, f"explode(array(sort_array(transform(slice(words, 1, greatest(size(words) - 2, 0)), (x, i) -> {window})))) s")
    twice = "filter(s, (x, i) -> (i > 0 and x.h = get(s, i - 1).h) or x.h <=> get(s, i + 1).h)"
    df = df.selectExpr("id", *figures, f"explode(array(sort_array(transform({twice}, x -> x.p)))) at")
    covered = "aggregate(transform(at, (p, i) -> least(3, coalesce(get(at, i + 1) - p, 3))), 0L, (n, x) -> n + x)"
    return df.selectExpr("id", *figures, f"{covered} n_repeat_words").withColumnRenamed("id", id_column)


def votes(measured: DataFrame) -> DataFrame:
    """Adds v_<rule> for each rule: 1 good, -1 bad, 0 if it abstains."""
    return measured.withColumns({f"v_{k}": F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end") for k, (bad, good) in RULES.items()})


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 500) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM on (votes, documents): the share of good documents, and per rule the chance of each vote if (good, bad).

    It begins with the documents that draw a bad vote as the bad kind, and ends when no posterior moves by a millionth.
    """
    size = len(patterns[0][0]) if patterns else len(RULES)
    prior = [sum(PRIOR[v][c] for v in PRIOR) for c in (0, 1)]
    share, chances = 0.5, [{v: (PRIOR[v][0] / prior[0], PRIOR[v][1] / prior[1]) for v in PRIOR} for _ in range(size)]
    good = [0.0 if -1 in p else 1.0 for p, _ in patterns]
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        mass = sum(g * n for g, (_, n) in zip(good, patterns, strict=True))
        share = (mass + prior[0]) / (total + prior[0] + prior[1])
        for j in range(size):
            drawn = {v: list(PRIOR[v]) for v in PRIOR}
            for g, (pattern, n) in zip(good, patterns, strict=True):
                drawn[pattern[j]][0] += g * n
                drawn[pattern[j]][1] += (1 - g) * n
            chances[j] = {v: (drawn[v][0] / (mass + prior[0]), drawn[v][1] / (total - mass + prior[1])) for v in drawn}
        added = weights(chances)
        before, good = good, [_chance(share, added, p) for p, _ in patterns]
        if max(abs(a - b) for a, b in zip(before, good, strict=True)) < 1e-6:
            break
    bad_votes = [sum(c[-1][k] for c in chances) for k in (0, 1)]
    if bad_votes[0] > bad_votes[1]:  # the kinds have changed places
        share, chances = 1 - share, [{v: (b, g) for v, (g, b) in c.items()} for c in chances]
    return share, chances


def weights(chances: list[dict[int, tuple[float, float]]]) -> list[dict[int, float]]:
    """Per rule the logarithm of the odds that each vote, or abstention, adds."""
    return [{v: math.log(g / b) for v, (g, b) in c.items()} for c in chances]


def posterior(share: float, chances: list[dict[int, tuple[float, float]]], pattern: tuple[int, ...]) -> float:
    return _chance(share, weights(chances), pattern)


def _chance(share: float, added: list[dict[int, float]], pattern: tuple[int, ...]) -> float:
    odds = math.log(share / (1 - share)) + sum(w[v] for w, v in zip(added, pattern, strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def judge(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, the figures, base_failed, the votes, p_good and kept."""
    measured = measures(df, id_column, text_column).withColumn("base_failed", F.expr(FAILED))
    voted = cut(votes(measured), "votes")
    names = [f"v_{k}" for k in RULES]
    counted = voted.where(~F.col("base_failed")).groupBy(*names).count().collect()  # at most 3 ** len(RULES) rows
    share, chances = fit(sorted((tuple(r[:-1]), r[-1]) for r in counted))
    odds = F.lit(math.log(share / (1 - share)))
    for name, w in zip(names, weights(chances), strict=True):
        odds = odds + F.when(F.col(name) == 1, w[1]).when(F.col(name) == -1, w[-1]).otherwise(w[0])
    out = voted.withColumn("p_good", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
