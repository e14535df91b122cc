import pytest
from pyspark.sql import functions as F

from tallyloom.functions import items, mcq, moves, text
from tallyloom.operators import chess, evaluate, sampling
from tallyloom.plans import catalogue


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr.alias("x")).first().x


@pytest.mark.parametrize(("said", "letter"), [("ANSWER: B", "B"), ("answer: c", "C"), ("ANSWER - A", "A"), ("B) Cell division", "B"), ("(C) Paris", "C"), ("The correct choice is (D).", "D"), ("I think B is right", "B"), ("Option C looks plausible but ANSWER: A", "A"), ("", None), ("no letters here", None), ("option E", None), ("42", None), ("a dog", "A"), ("b", None), ("B", "B")])
def test_parse_answer(spark, said, letter):
    assert one(spark, mcq.parse_answer(F.col("t")), t=said) == letter


def test_refusal(spark):
    rows = spark.createDataFrame([("I'm sorry, I cannot help with that.",), ("I'm sorry, but the answer is ANSWER: B",), ("",), (None,)], "t string")
    assert [r.x for r in rows.select(mcq.is_refusal(F.col("t")).alias("x")).collect()] == [True, False, False, False]


@pytest.mark.parametrize(("raw", "norm"), [("Hello, World!", "hello world"), ("one   two\n\tthree", "one two three"), ("the cat and a dog", "cat and dog"), ("a the an", ""), ("café naïve", "cafe naive"), (None, "")])
def test_normalise(spark, raw, norm):
    assert one(spark, text.normalise(F.col("t")), t=raw) == norm
    assert one(spark, text.normalise_exact(F.col("t")), t=raw) == norm


@pytest.mark.parametrize(("truth", "out", "want"), [("cat cat dog", "cat dog", (0.0, 0.8, None, None, 1 / 3)), ("something", "", (0.0, 0.0, 0.0, 0.0, 1.0)), ("", "", (1.0, 1.0, 0.0, 1.0, 0.0)), ("hello there big wide world", "hello there big wide world", (1.0, 1.0, 1.0, 1.0, 0.0)), ("", "word", (0.0, 0.0, 0.0, 0.0, 1.0))])
def test_text_scores(spark, truth, out, want):
    row = text.text_scores(spark.createDataFrame([(truth, out)], "t string, o string"), "t", "o").first()
    for got, w in zip(row[2:], want):
        assert w is None or got == pytest.approx(w, abs=1e-6)


def test_judge(spark):
    rows = spark.createDataFrame([(x,) for x in ("true", "NO", "0.75", "correct", None, "", "maybe", "n/a ")], "t string")
    assert [r.x for r in rows.select(text.judge(F.col("t")).alias("x")).collect()] == [1.0, 0.0, 0.75, 1.0, None, None, None, None]


TRUTH = "1 White b2 b3; 1 Black c7 c5; 2 White g1 f3; 2 Black b8 c6"
LINES = ["Move 1: White Pawn b2b3", "Move 1: Black Pawn c7 -> c5", "Move 2: White Knight g1 f3", "Move 2: Black Knight b8 to c6"]


@pytest.mark.parametrize(("lines", "strict", "loose", "hybrid"), [(LINES, 1.0, 1.0, 1.0), (LINES[:1], 0.25, 0.25, 0.0), ([LINES[0], LINES[3]], 0.25, 0.5, 0.0), (LINES[:2], 0.5, 0.5, 0.5), (["Move 9: White a1 a2", *LINES], 0.0, 1.0, 1.0), ([], 0.0, 0.0, 0.0)])
def test_moves(spark, lines, strict, loose, hybrid):
    row = moves.move_scores(spark.createDataFrame([(TRUTH, "\n".join(lines))], "t string, o string"), "t", "o").first()
    assert (row.score_strict, row.score_loose, row.score_hybrid) == (strict, loose, hybrid)


def test_alignment_is_longest():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 6))] for _ in range(2))
        best = max(len(s) for k in range(len(a) + 1) for s in itertools.combinations(a, k) if all(c in it for it in [iter(b)] for c in s))
        pairs = moves.aligned(a, b)
        assert len(pairs) == best and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)


def test_answers_and_plans(spark):
    rows = spark.createDataFrame([(x,) for x in ("A", "b", " c ", "2", "4", "E", "")], "t string")
    assert [r.x for r in rows.select(items.answer_letter(F.col("t")).alias("x")).collect()] == ["A", "B", "C", "C", "D", None, None]
    fpw = spark.createDataFrame([(30.0, 0.5), (30.0, 2.0), (30.0, 5.0), (10.0, 5.0), (30.0, 1000.0)], "f double, w double")
    assert [r.x for r in fpw.select(items.frames_per_word(F.col("f"), F.col("w")).alias("x")).collect()] == [60, 15, 6, 2, 1]
    holds = spark.createDataFrame([([15, 15],), ([60, 4],), ([7, 3],), ([],), ([0, 0],)], "h array<int>")
    assert [r.x for r in holds.select(items.gcd_of(F.col("h")).alias("x")).collect()] == [15, 4, 1, 1, 1]
    ids = spark.createDataFrame([("has space",), ("we!rd/na*me",), ("...",)], "t string")
    assert [r.x for r in ids.select(items.safe_id(F.col("t")).alias("x")).collect()] == ["has_space", "we_rd_na_me", "clip"]


def test_sampling(spark):
    assert sampling.allocate(10, 3) == [4, 3, 3] and sampling.allocate(2, 5) == [1, 1, 0, 0, 0]
    assert sampling.label(120) == "<2min" and sampling.label(3) == "<3s"
    rows = spark.createDataFrame([(f"v{i:03d}", float(i % 10)) for i in range(30)], "id string, d double")
    pick = lambda r: [x.id for x in sampling.sample_buckets(r, "d", "id", [0, 3, 5, 10], per_bucket=2).orderBy("bucket", "rank").collect()]
    assert pick(rows) == pick(rows.orderBy(F.desc("id"))) and len(pick(rows)) == 6


def test_summary_skips_blanks(spark):
    rows = spark.createDataFrame([("x", "1.0"), ("x", ""), ("y", None)], "g string, m string")
    assert [tuple(r) for r in evaluate.summarise(rows, ["g"], ["m"]).collect()] == [("x", 2, 1.0), ("y", 1, None)]


def test_unknown_experiment_raises(spark):
    rows = spark.createDataFrame([("zzz", "A", "A")], "experiment string, ground_truth string, model_output string")
    with pytest.raises(Exception, match="no scorer"):
        evaluate.score(rows).collect()


def test_chess():
    assert [chess.perft(k) for k in (1, 2, 3)] == [20, 400, 8902]
    assert chess.plies(7, 30) == chess.plies(7, 30)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def turns(spark, tmp_path, *texts):
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id int, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def test_wer_of_whole_turns(spark, tmp_path):
    import random

    rng = random.Random(5)
    said = [" ".join(f"w{rng.randrange(k)}" for _ in range(n)) for k, n in ((9, 150), (9, 170), (400, 300), (400, 20), (3, 70))]
    said.append(said[-1] + " more words at this end")
    got = {r.turn: r.wer for r in catalogue.QUERIES["text_wer"](spark, turns(spark, tmp_path, *said)).collect()}
    assert got == {i: pytest.approx(edits(a.split(), b.split()) / len(a.split()), abs=1e-6) for i, (a, b) in enumerate(zip(said, said[1:]))}


def test_char_similarity_of_all_pairs(spark, tmp_path):
    said = ["straße und gruß", "strasse und gruss", "привет мир", "привет, миры!", "καλημέρα κόσμε", "日本語 テキスト", "日本 テキスト", "plain words", ""]
    got = {r.turn: r.sim for r in catalogue.QUERIES["text_char_similarity"](spark, turns(spark, tmp_path, *said)).collect()}
    flat = [text_of(t) for t in said]
    assert got == {i: pytest.approx(1 - edits(a, b) / max(len(a), len(b)), abs=1e-6) for i, (a, b) in enumerate(zip(flat, flat[1:]))}


def text_of(t):
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
    return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in plain).split())


def test_normalise_decomposes(spark):
    texts = ["ﬁnal ﬀ", "ＦＵＬＬ　Ｗｉｄｔｈ", "x² ½ ①", "tiếng Việt", "tie\u0302\u0301ng Vie\u0323\u0302t", "Ω ǆ Ǆ ŉ ſ", "ΟΔΟΣ", "हिन्दी में", "İstanbul ß æ ø", "日本語ｶﾞ", "a\u00a0b\u2003c", "x…y", None]
    texts += [f"x{chr(c)}y {chr(c)}" for c in (*range(0x20, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x2190), *range(0xFB00, 0xFB07))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.normalise(F.col("t")).alias("a"), text.normalise_exact(F.col("t")).alias("b"))
    assert [r.t for r in rows.collect() if r.a != r.b] == []


def test_two_forms_of_a_word_match(spark):
    row = text.text_scores(spark.createDataFrame([("tiếng ﬁn", "tie\u0302\u0301ng fin")], "t string, o string"), "t", "o").first()
    assert (row.score_exact_match, row.score_token_f1, row.score_char_similarity, row.score_wer) == (1.0, 1.0, 1.0, 0.0)


def test_wer_of_many_distinct_words(spark):
    words = [f"w{i}" for i in range(36_000)]
    rows = spark.createDataFrame([(" ".join(words), "w5 x w7 w7 w35999"), ("w1 w2", "w1 w3")], "t string, o string")
    told = rows.withColumns({"r": text.tokens(F.col("t")), "h": text.tokens(F.col("o"))})
    got = told.select(text.word_error_rate(F.col("r"), F.col("h")).alias("x")).collect()
    assert [r.x for r in got] == [pytest.approx(35_997 / 36_000, abs=1e-9), 0.5]


def test_word_edits_equal_brute_force(spark):
    import random

    rng = random.Random(8)
    cases = [tuple([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2)) for _ in range(80)]
    rows = spark.createDataFrame(cases, "a array<string>, b array<string>").select("a", "b", text._word_edits(F.col("a"), F.col("b")).alias("x"))
    assert all(r.x == edits(r.a, r.b) for r in rows.collect())


def test_games_of_full_length(spark):
    games = catalogue.QUERIES["game_transcripts"](spark, "unused").collect()
    assert len(games) == 20 and max(g.n_half_moves for g in games) > 40 and any("limit" not in g.result for g in games)


def test_overlap_of_few_and_of_many(spark):
    import random
    from collections import Counter

    rng = random.Random(2)
    rows = [([rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n)], [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(m)]) for n, m in ((0, 0), (0, 5), (5, 0), (40, 30), (3000, 2500), (1, 4000))]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", text.overlap(F.col("a"), F.col("b")).alias("n"), text._sorted_overlap(F.col("a"), F.col("b")).alias("m")).collect()
    for r in got:
        assert r.n == r.m == sum((Counter(r.a) & Counter(r.b)).values())


def test_moves_by_one_pass_a_pattern(spark):
    from tallyloom.functions import moves

    texts = ["\x011 white e2 E4\x02; 2 BLACK\te7 e5\x01", "1 White e2 e4\n\n 2 black e7 e5 ", "99999999999999999999 white a1 a2 1 black b1 b2", "Move 3: white Pawn e2 -> e4\x01Move 3 black e7e5", "", None]
    out = spark.createDataFrame(enumerate(texts), "i int, t string").select("i", moves.parse_transcript(F.col("t")).alias("a"), moves.parse_model_output(F.col("t")).alias("b"))
    got = {r.i: ([tuple(m) for m in r.a], [tuple(m) for m in r.b]) for r in out.collect()}
    both = [(1, "White", "e2", "e4"), (2, "Black", "e7", "e5")]
    assert got[0] == (both, both[:1] + [(2, "Black", "e7", "e5")]) and got[1][0] == both
    assert got[2][0] == [(None, "White", "a1", "a2"), (1, "Black", "b1", "b2")]
    assert got[3] == ([], [(3, "White", "e2", "e4"), (3, "Black", "e7", "e5")]) and got[4] == got[5] == ([], [])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "initcap" not in plan


def test_alignment_by_numbers(spark):
    from pyspark.util import PythonEvalType
    from tallyloom.functions import distances, moves

    rows = [(0, ["a", "b", "c", "b"], ["b", "c", "a", "b"]), (1, [], ["a"]), (2, ["a"], []), (3, ["a", "b"], ["a", "x", "b"]), (4, ["x"] * 300 + ["y"], ["y"] + ["x"] * 300)]
    got = {r.i: tuple(r.m) for r in spark.createDataFrame(rows, "i int, t array<string>, f array<string>").select("i", moves.alignment("t", "f").alias("m")).collect()}
    assert got == {0: (0.75, 0.75, 3), 1: (0.0, 0.0, 0), 2: (0.0, 0.0, 0), 3: (1.0, 1.0, 2), 4: (300 / 301, 300 / 301, 300)}
    assert moves.alignment.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    long = [i % 7 for i in range(400)], [i % 5 for i in range(400)]
    whole, distances.SHORT = distances.SHORT, 0
    try:
        in_blocks = distances.common(*long)
    finally:
        distances.SHORT = whole
    assert in_blocks == distances.common(*long)
