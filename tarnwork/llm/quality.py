"""Quality by weak supervision: rules vote or abstain, expectation-maximisation says how far to trust each.

Each rule votes good (1), bad (-1) or abstains (0) on a text. The latent class of a document is estimated from the votes
alone: a rule's chances of each vote given the class, and the classes' shares, are fitted by expectation-maximisation
over the counts of vote patterns in all documents (at most 3 to the number of rules, however many documents), starting
from rules that are mostly right. A document is kept if its pattern's posterior probability of good is at least a half.

Defined results: a null or empty text has no words, all its counts are 0; every row gets its result, repeated rows the same;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.llm.common import as_bytes, mix, slices, unused, written

_SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\r\x0b\x0c"
_BEYOND = bytes(range(0x80, 0x100))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_letters", "n_upper", "n_wordlike")


def _repeats(words: list[bytes], k: int = 3) -> int:
    """Words in windows of k words that the text has more than once."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    one = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + one[i : i + n])
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(k):
        covered[i : i + n] |= twice
    return int(covered.sum())


def counts(text: bytes | None) -> list[int]:
    """COUNTS of a text in UTF-8."""
    text = text or b""
    words = text.split()
    packed = b"".join(words)
    chars = len(packed.decode())
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    ended = sum(x.rstrip(_BLANK)[-1:] in b".!?:" for x in lines)
    upper = len(packed) - len(packed.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    ascii_letters = len(packed) - len(packed.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    letters = ascii_letters + chars - len(packed.translate(None, _BEYOND))
    wordlike = sum(map(bytes.isalnum, (w.translate(None, b".,;:!?'\"()-").translate(_LETTERS) for w in words)))
    symbols = len(packed) - len(packed.translate(None, _SYMBOLS))
    return [len(words), chars, symbols, len(lines) - len(set(lines)), _repeats(words), len(lines), ended, letters, upper, wordlike]


#: Bytes of letters beyond ASCII count as letters; digits do not.
_LETTERS = bytes(0x61 if c >= 0x80 else 0x23 if 0x30 <= c <= 0x39 else c for c in range(256))


def features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` without its text, with COUNTS as longs."""
    rest = [c for c in df.columns if c != text_col and c not in COUNTS]
    schema = T.StructType([*(df.schema[c] for c in rest), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = np.array([counts(x) for x in as_bytes(part.column(text_col))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *(pa.array(found[:, k]) for k in range(len(COUNTS)))], names=[*rest, *COUNTS])

    return df.select(*rest, text_col).mapInArrow(run, schema)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """What each rule votes, over COUNTS."""
    c = {name: F.col(name).cast("double") for name in COUNTS}
    words, lines = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["n_lines"], F.lit(1.0))
    length = c["word_chars"] / words
    marked, shouted = c["n_symbols"] > 0.1 * words, c["n_upper"] > 0.4 * c["n_letters"]
    none = F.lit(False)
    return {
        "word_length": _vote(length.between(3.0, 9.0), ~length.between(2.5, 12.0)),
        "prose": _vote(((c["n_ended_lines"] >= 0.7 * lines) | (lines < 3)) & (c["n_symbols"] <= 0.02 * words) & (c["n_upper"] <= 0.15 * c["n_letters"]), none),
        "symbols": _vote(none, marked),
        "capitals": _vote(none, shouted),
        "dup_lines": _vote(none, c["n_dup_lines"] > 0.4 * lines),
        "repeats": _vote(none, c["n_repeat_words"] > 0.3 * words),
        "line_ends": _vote(none, (lines >= 3) & (c["n_ended_lines"] < 0.2 * lines)),
        "wordlike": _vote(none, c["n_wordlike"] < 0.6 * words),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, np.ndarray]:
    """Share of good documents and chances[class][rule][vote + 1], class 1 being good, from (votes, documents)."""
    votes = np.array([p for p, _ in patterns], int) + 1
    n = np.array([k for _, k in patterns], float)
    k = votes.shape[1]
    prior = np.array([[0.35, 0.40, 0.25], [0.01, 0.49, 0.50]])  # what a rule is taken to be before any data
    chances, share = np.repeat(prior[:, None, :], k, axis=1), 0.7
    strength = 0.01 * n.sum() + 1  # the prior's weight, so that no rule is trusted without bound
    for _ in range(rounds):
        post = posterior(votes - 1, share, chances)
        new = np.empty_like(chances)
        for c, w in enumerate((n * (1 - post), n * post)):
            for v in range(3):
                new[c, :, v] = ((votes == v) * w[:, None]).sum(0)
            new[c] = (new[c] + strength * prior[c]) / (w.sum() + strength)
        share_new = float((n @ post + 0.7 * strength) / (n.sum() + strength))
        done = abs(new - chances).max() < 1e-7 and abs(share_new - share) < 1e-7
        chances, share = new, share_new
        if done:
            break
    return share, chances


def posterior(votes: np.ndarray, share: float, chances: np.ndarray) -> np.ndarray:
    """Probability of good for each row of votes."""
    at = np.arange(votes.shape[1])
    logs = [np.log(chances[c][at, votes + 1]).sum(1) + np.log(p) for c, p in enumerate((1 - share, share))]
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def judge(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` without its text, with COUNTS and p_good, the posterior probability of good quality."""
    voting = rules()
    found = written(features(df, text_col), "quality")
    pattern = unused(found, "_pattern")
    found = found.withColumn(pattern, F.array(*voting.values()))
    patterns = [(tuple(r[0]), r[1]) for r in found.groupBy(pattern).count().collect()]  # at most 3 ** len(rules())
    if not patterns:
        return found.drop(pattern).withColumn("p_good", F.lit(None).cast("double"))
    share, chances = fit(patterns)
    votes = np.array([p for p, _ in patterns], int)
    known = df.sparkSession.createDataFrame([(p.tolist(), float(x)) for p, x in zip(votes, posterior(votes, share, chances), strict=True)], f"{pattern} array<int>, p_good double")
    return found.drop("p_good").join(F.broadcast(known), pattern).drop(pattern)
