import random
from collections import defaultdict
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from replylens.operators import pairwise, sampling

chosen = random.Random(3)


def mean(values):
    return sum(values) / len(values) if values else 0.0


def similarity(rows):
    """Straight from the definition, in order of position."""
    groups = defaultdict(list)
    for model, pos, text in sorted(rows, key=lambda r: (r[0], r[1])):
        groups[model].append(text)
    return {m: mean([SequenceMatcher(None, a, b).ratio() for a, b in combinations(t, 2)]) for m, t in groups.items()}


def words(n):
    return " ".join(chosen.choice(["good", "bad", "food", "service", "slow", "warm"]) for _ in range(n))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(pairwise, "TEXT_BLOCK", 3)
    monkeypatch.setattr(pairwise, "RANGE_TEXTS", 4)
    monkeypatch.setattr(pairwise, "RANGE_ROWS", 7)
    monkeypatch.setattr(pairwise, "STEP", 3)
    monkeypatch.setattr(pairwise, "PART_GROUPS", 2)
    monkeypatch.setattr(pairwise, "KEY_SET_BLOCK", 2)
    monkeypatch.setattr(pairwise, "KEY_COLUMNS", 2)
    monkeypatch.setattr(pairwise, "RARE_SETS", 6)


def check_texts(spark, rows):
    got = pairwise.format_consistency(spark.createDataFrame(rows, "model STRING, pos BIGINT, response STRING"))
    assert {r.model: r.format_consistency for r in got.collect()} == pytest.approx(similarity(rows), abs=1e-12)


def test_texts_against_difflib(spark, small_blocks):
    rows = [(f"m{i % 2}", i, words(chosen.randint(1, 60))) for i in range(24)]
    check_texts(spark, rows + [("single", 1, "alone")])


def test_order_and_copies_matter(spark, small_blocks):
    # copies interleaved over several merge spans, next to texts whose similarity depends on the order
    texts = ["abcd" * 60, "bcda" * 55 + "x", "hot", words(50), ""]
    rows = [("m", i * 50_000, texts[0] if i % 3 == 0 else chosen.choice(texts)) for i in range(30)]
    chosen.shuffle(rows)
    check_texts(spark, rows)


@pytest.mark.parametrize("groups", [1, 5])
def test_many_groups_share_texts(spark, small_blocks, groups):
    texts = [words(chosen.randint(3, 12)) for _ in range(7)]
    check_texts(spark, [(f"m{chosen.randrange(groups)}", i, chosen.choice(texts)) for i in range(160)])


def tile_of(models, length, texts):
    """One tile with the texts of a log, and the log."""
    rows = [(g, pos, chosen.randrange(len(texts))) for g in range(models) for pos in range(length)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)] + [pa.array([1] * len(rows))], names=["gid", "pos", "h", "bytes"])
    ranges = list(pairwise._ranged(6, 50, 4)([batch]))
    within = pd.concat([b.to_pandas() for r in ranges for b in pairwise._dealt(1, 1)([r])])
    frame = []
    for h, text in enumerate(texts):
        places = [(r["gid"][0].as_py(), r["first"][0].as_py(), dict(zip(r["hashes"][0].as_py(), r["counts"][0].as_py(), strict=True))[h])
                  for r in ranges if h in r["hashes"][0].as_py()]
        frame.append((h, text, 0, 0, 0, *map(list, zip(*places, strict=True))))
    columns = ["h", "text", "block", "tile_low", "tile_high", "gids", "firsts", "counts"]
    return pairwise._Tile(pd.DataFrame(frame, columns=columns), within), [(g, pos, texts[t]) for g, pos, t in rows]


def test_comparisons_do_not_depend_on_models_or_length_of_the_log(monkeypatch):
    texts = [words(chosen.randint(3, 12)) for _ in range(9)]
    calls, plain = [], pairwise.matched_characters
    monkeypatch.setattr(pairwise, "matched_characters", lambda *args: calls.append(1) or plain(*args))
    for models, length in ((1, 400), (7, 400), (3, 90)):
        calls.clear()
        tile, rows = tile_of(models, length, texts)
        got = tile.sums(pairwise.ratios).set_index("gid")["pair_sum"] / (length * (length - 1) / 2)
        assert len(calls) == 9 * 8
        assert got.to_dict() == pytest.approx(similarity(rows), abs=1e-12)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def test_edit_distance():
    for _ in range(400):
        a, b = ("".join(chosen.choices("abé\U0001f600", k=chosen.randint(0, 90))) for _ in range(2))
        a = chosen.choice([a, b[:5] + a + b[-7:]])
        assert pairwise.edit_distance(a, b) == plain_distance(a, b)


def test_edit_similarity_of_pairs(spark, small_blocks):
    rows = [(f"m{i % 2}", i, chosen.choice(["", words(2), words(9), "same"])) for i in range(40)] + [("one", 1, "alone")]
    groups = defaultdict(list)
    for model, _, text in rows:
        groups[model].append(text)
    want = {m: mean([1 - plain_distance(a, b) / max(len(a), len(b), 1) for a, b in combinations(t, 2)]) for m, t in groups.items()}
    got = pairwise.format_consistency(spark.createDataFrame(rows, "model STRING, pos BIGINT, response STRING"), mode="levenshtein")
    assert {r.model: r.format_consistency for r in got.collect()} == pytest.approx(want, abs=1e-12)


def test_sampled_mean_is_inside_its_interval(spark):
    texts = [words(chosen.randint(3, 12)) for _ in range(40)] + ["same"] * 10
    rows = [(f"m{i % 3}", i * 7, chosen.choice(texts)) for i in range(450)] + [("one", 1, "a"), ("two", 1, "a"), ("two", 2, "a")]
    frame = spark.createDataFrame(rows, "model STRING, pos BIGINT, response STRING")
    got = {r.model: r for r in sampling.sampled_consistency(frame, draws=3000).collect()}
    for model, want in similarity(rows).items():
        # twice the half width: one draw of three groups may lie outside the interval itself
        assert abs(got[model].format_consistency - want) <= 2 * got[model].half_width + 1e-12, model
        assert got[model].half_width < 0.01
    assert (got["one"].format_consistency, got["one"].pairs, got["two"].format_consistency) == (0.0, 0, 1.0)
    assert 2500 < got["m0"].pairs <= 3000


def test_no_replies(spark):
    assert pairwise.format_consistency(spark.createDataFrame([], "model STRING, pos BIGINT, response STRING")).count() == 0


def test_repeated_positions_are_refused(spark):
    rows = spark.createDataFrame([("m", 1, "a"), ("m", 1, "b")], "model STRING, pos BIGINT, response STRING")
    with pytest.raises(Exception, match="positions repeat"):
        pairwise.format_consistency(rows).collect()


def test_one_text_everywhere(spark):
    got = pairwise.format_consistency(spark.range(500).selectExpr("'m' model", "id pos", "'same' response"))
    assert got.first().format_consistency == 1.0


def key_sets(rows):
    groups = defaultdict(list)
    for model, keys in rows:
        if keys is not None:
            groups[model].append(set(keys))
    return {m: mean([len(a & b) / len(a | b) for a, b in combinations(s, 2)]) for m, s in groups.items()}


def check_keys(spark, rows):
    got = pairwise.structure_consistency(spark.createDataFrame(rows, "model STRING, json_keys ARRAY<STRING>"))
    assert {r.model: r.json_structure_consistency for r in got.collect()} == pytest.approx(key_sets(rows), abs=1e-12)


def test_key_sets_against_pairs(spark, small_blocks):
    rows = [
        (f"m{i % 3}", sorted(chosen.sample("abcdefg", chosen.randint(1, 5))) if i % 7 else None) for i in range(120)
    ]
    check_keys(spark, rows + [("one", ["a"])])


@pytest.mark.parametrize("rare", [0, 3, 1000])
def test_frequent_and_rare_keys(spark, monkeypatch, rare):
    monkeypatch.setattr(pairwise, "RARE_SETS", rare)
    names = ["all", "most"] + [f"k{i}" for i in range(40)]
    rows = []
    for i in range(150):
        keys = {"all"} | ({"most"} if chosen.random() < 0.7 else set()) | set(chosen.sample(names[2:], chosen.randint(0, 4)))
        rows.append((f"m{i % 2}", chosen.sample(sorted(keys), len(keys)) if i % 9 else ["alone", f"x{i}"]))
    check_keys(spark, rows + [("other", ["a"]), ("other", ["b"]), ("other", [])][:2])


def test_very_many_key_sets(spark):
    """100,000 sets {all, i, i + 1}: neighbours share two keys of four, others one of five."""
    n = 100_000
    sets = spark.range(n).selectExpr("'m' model", "array('all', concat('k', id), concat('k', id + 1)) json_keys")
    pairs = n * (n - 1) / 2
    want = ((n - 1) * 2 / 4 + (pairs - n + 1) / 5) / pairs
    assert pairwise.structure_consistency(sets).first()[1] == pytest.approx(want, rel=1e-12)


def test_golden_key_sets(spark):
    check_keys(spark, [("m", ["a"]), ("m", ["a"]), ("m", ["a", "b"])])


def test_weighted_key_sets(spark):
    rows = [("m", ["a"], 2), ("m", ["a", "b"], 1)]
    df = spark.createDataFrame(rows, "model STRING, json_keys ARRAY<STRING>, n BIGINT")
    assert pairwise.structure_consistency(df, replies="n").first()[1] == pytest.approx(2 / 3)


def test_pair_counts(spark):
    rows = pairwise.pair_counts(spark.range(7).selectExpr("'m' model", "id pos")).collect()
    assert [tuple(r) for r in rows] == [("m", 7, 21)]


@pytest.mark.parametrize("most", [1 << 17, 3000])
def test_pairs_are_compared_together_as_difflib_does(monkeypatch, most):
    made = []
    monkeypatch.setattr(pairwise, "SequenceMatcher", lambda *given: made.append(given) or SequenceMatcher(*given))
    monkeypatch.setattr(pairwise, "POINTS", most)
    monkeypatch.setattr(pairwise, "FEW_PAIRS", 0)
    seed = random.Random(7)
    texts = ["", "x", "\U0001f600a" * 130, "ab" * 50]
    texts += ["".join(seed.choice("ab cdé" if n % 2 else "abcdefghijklmnop ") for _ in range(seed.choice([40, 199, 200, 600]))) for n in range(6)]
    texts += [t[3:90] + "q" + t[80:] for t in texts[-4:]]
    wanted = [[i != j and seed.random() < 0.8 for j in range(len(texts))] for i in range(len(texts))]
    got = pairwise.ratios(texts, np.array(wanted))
    for i, first in enumerate(texts):
        for j, second in enumerate(texts):
            assert got[i, j] == (SequenceMatcher(None, first, second).ratio() if wanted[i][j] else 0)
    # one pair at a time only where it has too many points to be held with others
    assert bool(made) == (most < 1 << 17)


def uneven(seed, n):
    """A text of a few frequent characters and many that are rare."""
    return "".join(seed.choice("etaoin  ") if seed.random() < 0.9 else seed.choice("bcdfghjklmpqrsuvwxyzBCDFGHJKL.,;") for _ in range(n))


def test_points_are_listed_for_rows_of_characters_only(monkeypatch):
    seed, listed, runs = random.Random(11), [], pairwise._Matches._runs
    monkeypatch.setattr(pairwise._Matches, "_runs", lambda self, i, *more: listed.append(len(i)) or runs(self, i, *more))
    texts = [uneven(seed, seed.randint(250, 900)) for _ in range(16)]
    pairs = list(combinations(range(len(texts)), 2))
    got = pairwise.ratios(texts, np.triu(np.ones((16, 16), bool), 1))
    assert {p: got[p] for p in pairs} == {(i, j): SequenceMatcher(None, texts[i], texts[j]).ratio() for i, j in pairs}
    places = [SequenceMatcher(None, "", text).b2j for text in texts]
    single = sum(len(places[j].get(c, ())) for i, j in pairs for c in texts[i])
    assert sum(listed) < single / 5


@pytest.mark.parametrize("limits", [{}, {"CELLS": 0}, {"CELLS": 30_000}, {"COLUMNS": 3}, {"ROW_CELLS": 1}, {"POINTS": 700}], ids=str)
def test_limits_of_the_arrays_do_not_change_ratios(monkeypatch, limits):
    for name, value in ({"FEW_PAIRS": 0} | limits).items():
        monkeypatch.setattr(pairwise, name, value)
    seed = random.Random(13)
    texts = ["", "e", "\U0001f600", "éte" * 20] + [uneven(seed, seed.choice([30, 199, 200, 450])) for _ in range(10)]
    texts += [t[5:150] + "中" + t[100:] for t in texts[-5:]]
    wanted = ~np.eye(len(texts), dtype=bool)
    got = pairwise.ratios(texts, wanted)
    for i, j in np.argwhere(wanted).tolist():
        assert got[i, j] == SequenceMatcher(None, texts[i], texts[j]).ratio()
