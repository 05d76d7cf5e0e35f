"""Language identification by unigram pieces, summed over all segmentations."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framedrift.llm.common import fold, settle, unused

UNKNOWN = "und"
WORD_START = "▁"
WORDS = re.compile(r"[^\W\d_]+")
LONGEST_PIECE = 16
LONGEST_IN_BLOCK = 24  # letters; the sums of longer words are kept in logs
LETTERS_AT_ONCE = 1 << 14
CACHED_WORDS = 400_000
SMOOTHING = 0.01
BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(model_path: str) -> list[str]:
    """Lower-case letter pieces of a sentencepiece model, word starts marked, in order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    letters = [p for p in pieces if p == p.lower() and (p == WORD_START or p.removeprefix(WORD_START).isalpha())]
    return [p for p in dict.fromkeys(letters) if len(p) <= LONGEST_PIECE]


def _codes(words: list[str]) -> np.ndarray:
    width = max(map(len, words))
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


class PieceModel:
    """``chance[piece, language]``; its last two rows are an unknown letter and a piece that is none."""

    def __init__(self, pieces: list[str], chance: np.ndarray):
        codes = _codes(pieces)
        self.pieces, self.chance, self.longest = pieces, chance, codes.shape[1]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        hashes = self._prefixes(codes)[np.arange(len(pieces)), sizes]
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order

    @staticmethod
    def start(pieces: list[str], languages: int) -> PieceModel:
        chance = np.full((len(pieces) + 2, languages), 1.0 / (len(pieces) + 1))
        chance[-1] = 0
        return PieceModel(pieces, chance)

    def learned(self, counts: np.ndarray) -> PieceModel:
        """The model with chances from expected counts (same shape)."""
        smooth = counts[:-1] + SMOOTHING
        return PieceModel(self.pieces, np.vstack([smooth / smooth.sum(axis=0), np.zeros((1, counts.shape[1]))]))

    @staticmethod
    def _prefixes(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * BASE + codes[:, j]
        return out

    def _find(self, prefixes: np.ndarray, i: int, j: int, rows: slice) -> np.ndarray:
        """Row of ``chance`` of the letters i to j of each word."""
        power = np.uint64(pow(int(BASE), j - i, 1 << 64))
        wanted = prefixes[rows, j] - prefixes[rows, i] * power
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        missing = len(self.pieces) + (j - i > 1)
        return np.where(self.hashes[at] == wanted, self.ids[at], missing)

    def _block(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, dict, np.ndarray, np.ndarray]:
        """Forward sums of words of up to LONGEST_IN_BLOCK letters, longest first."""
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        codes = _codes([WORD_START + words[i] for i in order])
        prefixes, found = self._prefixes(codes), {}
        ahead = np.zeros((codes.shape[1] + 1, len(words), self.chance.shape[1]))
        ahead[0] = 1
        for j in range(1, codes.shape[1] + 1):
            rows = slice(0, int(np.searchsorted(-sizes, -j, side="right")))
            for i in range(max(0, j - self.longest), j):
                found[i, j] = self._find(prefixes, i, j, rows)
                ahead[j, rows] += ahead[i, rows] * self.chance[found[i, j]]
        return order, sizes, found, ahead, ahead[sizes, np.arange(len(words))]

    def _ids(self, prefixes: np.ndarray, sizes: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Rows of ``chance`` of all pieces that end at the letters begin + 1 to end of each word, by the piece's size."""
        none = len(self.pieces) + 1
        ids = np.full((len(prefixes), end - begin, self.longest), none)
        for k in range(1, self.longest + 1):
            first = max(begin, k - 1)
            if first >= end:
                break
            power = np.uint64(pow(int(BASE), k, 1 << 64))
            wanted = prefixes[:, first + 1 : end + 1] - prefixes[:, first + 1 - k : end + 1 - k] * power
            at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
            ids[:, first - begin :, k - 1] = np.where(self.hashes[at] == wanted, self.ids[at], none - (k == 1))
        ids[np.arange(begin, end) >= sizes[:, None]] = none
        return ids

    def _long(self, words: list[str], language: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(prefixes, sizes, log) of words of any length: log forward sums at each letter, of each word's ``language``.

        Without languages, at the end only and for all of them. Sums are kept relative to the letter before,
        so nothing underflows.
        """
        codes = _codes([WORD_START + w for w in words])
        prefixes, sizes = self._prefixes(codes), np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        width = codes.shape[1]
        columns = self.chance.shape[1] if language is None else 1
        ring = np.zeros((len(words), self.longest, columns))
        ring[:, 0] = 1
        log = np.zeros((len(words), columns))
        logs = np.zeros((len(words), width + 1))
        for begin in range(0, width, LETTERS_AT_ONCE):
            end = min(width, begin + LETTERS_AT_ONCE)
            ids = self._ids(prefixes, sizes, begin, end)
            for j in range(begin, end):
                at = ids[:, j - begin]
                chance = self.chance[at] if language is None else self.chance[at, language[:, None]][:, :, None]
                total = np.where((j < sizes)[:, None], (chance * ring).sum(axis=1), 1.0)
                log += np.log(total)
                ring[:, 1:] = ring[:, :-1] / total[:, None]
                ring[:, 0] = 1
                if language is not None:
                    logs[:, j + 1] = log[:, 0]
        return prefixes, sizes, log if language is None else logs

    @staticmethod
    def _long_groups(words: list[str], some: list[int]) -> Iterator[np.ndarray]:
        """Numbers of long words, alike in length, so that a group has about LETTERS_AT_ONCE letters."""
        some = sorted(some, key=lambda i: len(words[i]))
        while some:
            n = max(1, LETTERS_AT_ONCE // len(words[some[-1]]))
            yield np.array(some[-n:])
            some = some[:-n]

    def log_chance(self, words: list[str]) -> np.ndarray:
        """log of each word's chance in each language, summed over all ways to cut it into pieces."""
        out = np.zeros((len(words), self.chance.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= LONGEST_IN_BLOCK]
        if short:
            order, _, _, _, total = self._block([words[i] for i in short])
            out[np.array(short)[order]] = np.log(total)
        for group in self._long_groups(words, [i for i, w in enumerate(words) if len(w) > LONGEST_IN_BLOCK]):
            out[group] = self._long([words[i] for i in group])[2]
        return out

    def expected(self, words: list[str], language: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected piece counts of words seen ``times`` in ``language``."""
        counts = np.zeros_like(self.chance)
        short = np.flatnonzero([len(w) <= LONGEST_IN_BLOCK for w in words])
        if len(short):
            self._expect_short([words[i] for i in short], language[short], times[short], counts)
        for group in self._long_groups(words, [i for i, w in enumerate(words) if len(w) > LONGEST_IN_BLOCK]):
            self._expect_long([words[i] for i in group], language[group], times[group], counts)
        counts[-1] = 0
        return counts

    def _expect_long(self, words: list[str], language: np.ndarray, times: np.ndarray, counts: np.ndarray) -> None:
        """The same for long words: backward sums relative to the letter behind, joined with the forward ones in logs."""
        prefixes, sizes, ahead = self._long(words, language)
        whole = ahead[np.arange(len(words)), sizes]
        width = prefixes.shape[1] - 1
        behind = np.full((len(words), width + 1), -np.inf)
        behind[np.arange(len(words)), sizes] = 0.0
        of = language[:, None]
        for end in range(width, 0, -LETTERS_AT_ONCE):
            begin = max(0, end - LETTERS_AT_ONCE)
            ids = self._ids(prefixes, sizes, begin, end)
            for j in range(end, begin, -1):  # pieces that end at letter j add to what is behind their beginnings
                k = min(j, self.longest)
                at = ids[:, j - 1 - begin, :k]
                chance = self.chance[at, of]
                with np.errstate(divide="ignore", invalid="ignore"):
                    logs = np.log(chance) + behind[:, j, None]
                    places = behind[:, j - k : j][:, ::-1]
                    behind[:, j - k : j] = np.logaddexp(places, np.where(chance > 0, logs, -np.inf))[:, ::-1]
                    used = np.exp(ahead[:, j - k : j][:, ::-1] + logs - whole[:, None]) * times[:, None]
                np.add.at(counts, (at, np.broadcast_to(of, at.shape)), np.where(chance > 0, used, 0.0))

    def _expect_short(self, words: list[str], language: np.ndarray, times: np.ndarray, counts: np.ndarray) -> None:
        order, sizes, found, ahead, total = self._block(words)
        language, weight = language[order], times[order] / np.maximum(total[np.arange(len(words)), language[order]], 1e-300)
        behind = np.zeros((ahead.shape[0], len(words)))
        behind[sizes, np.arange(len(words))] = 1
        for j in range(ahead.shape[0] - 1, 0, -1):
            for i in range(max(0, j - self.longest), j):
                ids = found[i, j]
                n = len(ids)
                used = self.chance[ids, language[:n]] * behind[j, :n]
                behind[i, :n] += used
                np.add.at(counts, (ids, language[:n]), used * ahead[i, np.arange(n), language[:n]] * weight[:n])


def sample_per_language(docs: DataFrame, sizes: dict[str, int], most: int) -> DataFrame:
    """About ``most`` rows (_text, _lang, _order) of each language: those whose order falls below its share."""
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, most / n))])
    return docs.where((F.pmod("_order", F.lit(1 << 20)) / (1 << 20)) < share[F.col("_lang")])


def train(docs: DataFrame, model_path: str, key: str, text: str, lang: str, per_language: int, rounds: int):
    """(languages, log priors, PieceModel) learned from rows with a language whose fold is not 0.

    Priors count all such rows. Piece chances are fitted by expectation maximisation on about
    ``per_language`` rows of each language, chosen by a hash of key and text.
    """
    rows = docs.where((fold(key) != 0) & F.col(lang).isNotNull()).select(
        F.col(text).alias("_text"), F.col(lang).alias("_lang"), F.xxhash64(key, text).alias("_order")
    )
    sizes = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().orderBy("_lang").collect()}
    if not sizes:
        return [], np.zeros(0), None
    languages = list(sizes)
    prior = np.log(np.array([sizes[x] for x in languages]) / sum(sizes.values()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in WORDS.findall((t or "").lower()):
                    if w.isalpha():
                        seen[x, w] = seen.get((x, w), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
                ["_lang", "word", "n"],
            )

    drawn = sample_per_language(rows, sizes, per_language)
    words = settle(drawn.mapInArrow(count, "_lang string, word string, n long").groupBy("_lang", "word").agg(F.sum("n").alias("n")))
    pieces = vocabulary(model_path)
    model = PieceModel.start(pieces, len(languages))
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros_like(shared.value.chance)
            for batch in batches:
                if batch.num_rows:
                    of = np.array([languages.index(x) for x in batch.column(0).to_pylist()])
                    counts += shared.value.expected(batch.column(1).to_pylist(), of, batch.column(2).to_numpy())
            at, of = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(of.astype(np.int32)), pa.array(counts[at, of])], ["piece", "language", "n"]
            )

        # One row per piece and language comes back: the vocabulary is fixed.
        sums = words.mapInArrow(expect, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(model.chance)
        counts[sums["piece"], sums["language"]] = sums["n"]
        model = model.learned(counts)
    return languages, prior, model


def identify(
    docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 2000, rounds: int = 4
) -> DataFrame:
    """Adds ``held_out``, ``lang_pred`` and ``score`` to ``docs`` (replacing columns of these names).

    Texts are lower-cased and read as runs of letters. A word's chance in a language is the sum, over
    all ways to cut it into pieces of the public vocabulary at ``model_path``, of the product of the
    pieces' chances; the forward algorithm gives it. A text's chance is the product over all its words.
    ``score`` is the posterior of the best language with the training rows' shares as prior.

    Only rows with a language and crc32(key) mod 5 other than 0 are learned from. ``lang_pred`` is
    'und' and the score 0 for null texts, texts without a letter, and if there is nothing to learn
    from; ties go to the language that sorts first. Repeated rows are scored alike.
    """
    languages, prior, model = train(docs, model_path, key, text, lang, per_language, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        logs, letters = np.zeros((0, len(languages))), np.zeros(0, np.int64)
        for texts in batches:
            words = [WORDS.findall(t.lower()) if t and languages else [] for t in texts]
            new = list(set().union(*words) - known.keys())
            if new:
                pure = ["".join(c for c in w if c.isalpha()) if not w.isalpha() else w for w in new]
                some = [i for i, w in enumerate(pure) if w]
                more = np.zeros((len(new), len(languages)))
                if some:
                    more[some] = shared.value.log_chance([pure[i] for i in some])
                known.update(zip(new, range(len(logs), len(logs) + len(new)), strict=True))
                logs, letters = np.vstack([logs, more]), np.append(letters, [len(w) for w in pure])
            out = []
            for w in words:
                rows = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
                if not len(rows) or not letters[rows].any():
                    out.append((UNKNOWN, 0.0))
                    continue
                total = logs[rows].sum(axis=0) + prior
                best = int(np.argmax(total))
                out.append((languages[best], 1.0 / math.fsum(np.exp(np.maximum(total - total[best], -700)))))
            if len(known) > CACHED_WORDS:
                known.clear()
                logs, letters = logs[:0], letters[:0]
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    (_found,) = unused(docs.columns, "_found")
    found = docs.withColumn(_found, predict(F.col(text)))
    return found.withColumns(
        {"held_out": fold(key) == 0, "lang_pred": F.col(_found)["lang_pred"], "score": F.col(_found)["score"]}
    ).drop(_found)
