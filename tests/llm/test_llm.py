"""Small cases of the training-data operators: nulls, ties, repeats, empty tables, brute force, round trips."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import chat, components, graph_ann, html_text, jaccard_join, langid, mixing, packing, pii, quality, simple8b, tokens

LONG = " ".join(f"word{i}" for i in range(3000))
TEXTS = ["one two three four five six seven eight nine ten eleven twelve", None, "", " \t\n", LONG, LONG, "a b c", "A b  c", "x.\ny, z", "ends <|endoftext|> here", "é ñ 中文 text\n\nnext"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, offset string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None, "s0")[i % 4], 1, 7, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "no id here", "en", "s1", 1, 7, "x"), (0, TEXTS[0], "en", "s1", 1, 7, "x")], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def whole_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    return [np.asarray(e.ids, "<u4") for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_library():
    texts = [*TEXTS, "a  b", " a", "a ", "tab\tx", "don't we'll 12,5. x,y", "end.\nNext, one.", "\n", ".", ",", "a\x00b c", "x y"]
    got = list(tokens.Encoder.of(tokens.tokenizer_path()).encode(texts))
    assert [x.tobytes() for x in got] == [i.tobytes() for i in whole_ids(texts)]


def test_encoder_equals_library_when_its_table_is_renewed(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 20)
    monkeypatch.setattr(tokens, "CUT_BYTES", 200)
    texts = [f"the word{i % 7} and Mot{i % 5}, été\nzwölf{i % 3}. end" for i in range(60)]
    encoder = tokens.Encoder(tokens.tokenizer_path())
    assert [x.tobytes() for x in encoder.encode(texts)] == [i.tobytes() for i in whole_ids(texts)]
    assert len(encoder.memo) <= 60


@pytest.mark.parametrize("kind", ["small", "large", "zeros", "mixed", "none", "one"])
def test_simple8b_round_trip(kind):
    rng = np.random.default_rng(1)
    ids = {"small": rng.integers(0, 60_000, 5000), "large": rng.integers(0, 2**62, 300), "zeros": np.zeros(1000, int), "mixed": 2 ** rng.integers(0, 63, 2000), "none": np.empty(0, int), "one": np.array([5])}[kind].astype(np.uint64)
    words, raw = simple8b.pack(ids)
    assert (simple8b.unpack(words, raw, len(ids)) == ids).all()
    if kind == "zeros":
        assert len(words) < 20


def test_ids_file(spark, docs, empty, tmp_path):
    simple8b.write_ids(docs, str(tmp_path / "a"))
    got = simple8b.read_ids(spark, str(tmp_path / "a"), with_ids=True).orderBy("start").collect()
    assert len(got) == docs.count() and [r.doc_id for r in got] == sorted([r.doc_id for r in got], key=lambda x: -1 if x is None else x)
    want = {t: [*i.tolist(), 0] for t, i in zip(TEXTS, whole_ids(TEXTS))}
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        if r.doc_id is not None:
            assert r.ids == want[TEXTS[r.doc_id]]
        start += r.n_tokens
    simple8b.write_ids(empty, str(tmp_path / "b"))
    assert simple8b.read_ids(spark, str(tmp_path / "b")).count() == 0


def test_ids_file_of_many_blocks_and_shards(spark, tmp_path):
    texts = [" ".join(f"w{i * j % 91}" for j in range(i % 40)) for i in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    simple8b.write_ids(rows, str(tmp_path / "a"), shards=4, block_ids=500)
    shape = spark.read.parquet(str(tmp_path / "a" / "blocks")).groupBy("shard").count().collect()
    assert len(shape) > 2 and all(r["count"] > 2 for r in shape)
    start = 0
    for want, r in zip(whole_ids(texts), simple8b.read_ids(spark, str(tmp_path / "a"), with_ids=True).orderBy("doc_id").collect()):
        ids = np.append(want, np.uint32(0)).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (start, len(ids), zlib.crc32(ids), ids.tolist())
        start += len(ids)


def test_packing(docs, empty):
    got = packing.pack_documents(docs).toPandas()
    ids = {i: [*x.tolist(), 2] for i, x in enumerate(whole_ids(TEXTS))}
    for (doc, _), g in got.dropna(subset=["doc_id"]).groupby(["doc_id", "sequence_id"]):
        for r in g.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[int(doc)][r.start : r.start + r.length], "<u4").tobytes())
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 1024 and g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    assert (got[got.length < 1024].piece == 0).all()
    assert packing.pack_documents(empty).count() == 0


def test_best_fit_tree_is_near_the_bound(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(1, 700, 3000))], "item bigint, length bigint")
    got = packing.pack(rows, leaves=64).toPandas()
    used = got.groupby("sequence_id")["length"].sum()
    assert len(got) == 3000 and used.max() <= 1024 and len(used) <= 1.03 * -(-used.sum() // 1024)


@pytest.mark.parametrize("kind", ["large", "halves", "few"])
def test_bins_that_stay_behind_cost_no_sequence(spark, kind):
    rng = np.random.default_rng(4)
    lengths = {"large": rng.choice([600, 610, 380, 90], 4000, p=[0.7, 0.2, 0.05, 0.05]), "halves": rng.choice([513, 512, 511, 30], 3000), "few": np.array([1, 1023, 5])}[kind]
    rows = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "item bigint, length bigint")
    got = packing.pack(rows, leaves=16, fan_in=2).toPandas()
    whole = packing.pack(rows, leaves=16, fan_in=2000).toPandas()  # one step up, with all bins
    places = got.sort_values(["sequence_id", "offset"])
    ends = places.groupby("sequence_id")["length"].cumsum()
    assert (places.offset == ends - places.length).all() and ends.max() <= 1024 and len(got) == len(lengths)
    assert got.sequence_id.nunique() <= whole.sequence_id.nunique() + 1


def test_packing_refuses_what_does_not_fit(spark):
    for length in (1025, None):
        with pytest.raises(ValueError, match="capacity"):
            packing.pack(spark.createDataFrame([(1, length)], "item bigint, length bigint"))


def test_pseudonyms(docs, empty):
    p = pii.Permuter(b"k")
    for n in (2, 3, 1000):
        assert sorted(p.permute(i, n, "t") for i in range(n)) == list(range(n))
    made = pii.Pseudonymiser(b"k")
    raw = "call +1 (217) 555-0199, mail a.b@mail7.example.com, 4111111111111111 or 87.210.238.235 on 2024-02-29"
    text, spans = made.text(raw)
    assert [k for k, _, _ in spans] == ["phone", "email", "card", "ip", "date"] and not any(x in text for x in ("555-0199", "a.b@", "4111111111111111", "87.210.238.235", "2024-02-29"))
    card = next(text[a : a + n] for k, a, n in spans if k == "card")
    assert pii.luhn_digit(card[:-1]) == card[-1] and made.text(raw) == pii.Pseudonymiser(b"k").text(raw)
    assert made.text("Version 2.0, 1234567812345678 and 2024-13-01") == ("Version 2.0, 1234567812345678 and 2024-13-01", [])
    out = pii.pseudonymised(docs, key=b"k")
    assert out.columns == docs.columns and [r.text for r in out.collect()] == [r.text for r in docs.collect()]
    assert pii.pseudonymised(empty, key=b"k", spans="found").count() == 0


NUMBERS = {"us": "+1 (826) 555-4081", "de": "+49 30 1234567", "fr": "+33 1 23 45 67 89", "flat": "826-555-4081", "card": "4111 1111 1111 1111", "amex": "3782 822463 10005", "ip": "190.137.223.204", "date": "2024-05-06", "ssn": "123-45-6789", "iban": "DE89 3704 0044 0532 0130 00", "be": "BE68 5390 0754 7034"}


@pytest.mark.parametrize("names", [("us", "ip"), ("us", "us"), ("us", "date"), ("us", "card"), ("us", "ssn"), ("de", "ip"), ("de", "date"), ("de", "card"), ("de", "ssn"), ("de", "flat"), ("fr", "ip"), ("flat", "ip"), ("flat", "card"), ("card", "ip"), ("card", "date"), ("card", "card"), ("card", "us"), ("amex", "ip"), ("amex", "date"), ("iban", "ip"), ("be", "card"), ("be", "date"), ("us", "ip", "card", "date", "ssn")])
def test_pseudonyms_of_neighbours(names):
    made = pii.Pseudonymiser(b"k")
    alone = [made.text(NUMBERS[k])[0] for k in names]
    assert all(a != NUMBERS[k] for a, k in zip(alone, names))
    assert made.text("x " + " ".join(NUMBERS[k] for k in names) + " y")[0] == "x " + " ".join(alone) + " y"


@pytest.mark.parametrize("after", [" 12/25", " 123", " 7", " 10.0.0.1", "-12"])
@pytest.mark.parametrize("name", ["card", "amex", "us"])
def test_pseudonyms_before_other_digits(name, after):
    made = pii.Pseudonymiser(b"k")
    assert made.text(NUMBERS[name] + after)[0].startswith(made.text(NUMBERS[name])[0] + after[:1])
    assert made.text("12 " + NUMBERS[name])[0] == "12 " + made.text(NUMBERS[name])[0]


def test_quoted_credentials():
    raw = 'key = "' + "0123456789ABCDEFabcdef0123456789" + '"'
    assert [k for k, _, _ in pii.Pseudonymiser(b"k").text(raw)[1]] == ["credential"]


def test_main_text(spark):
    page = "<html><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class='ad'>Buy it now.</div><article><h1>A  title</h1><p>First &amp; only<br>paragraph of this text, with words.</p><script>var t='</p>';</script></article><div class='comments'><p>Nice one!</p></div><footer>&copy; us</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<p>Hello there, this is a < b text.")], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.extracted(rows).collect()}
    assert got[1] == "A title\nFirst & only paragraph of this text, with words." and got[2] == got[3] == got[4] == ""
    assert html_text.decode([-1, 0, 1, 1, 0], np.array([1.0, -3.0, 2.0, 2.0, -1.0])) == [True, True, True, True, False]
    assert html_text.decode([-1, 0, 1], np.array([1.0, -3.0, 2.0])) == [True, False, False]


def test_mixing(docs, empty):
    got = mixing.mix(docs).toPandas()
    assert len(got) == docs.count() and (got.taken <= 3 * got["size"]).all() and (got.target <= 3 * got.source_size + 1e-9).all()
    by = got.groupby("source", dropna=False)
    assert by.target.first().sum() == pytest.approx(got["size"].sum())
    assert mixing.mix(empty).count() == 0
    again = mixing.mix(docs).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns


def test_language(spark, docs):
    rows = [(f"the cat and the dog went to the house with {i} friends", "en") for i in range(30)] + [(f"der hund und die katze gingen mit {i} freunden nach haus", "de") for i in range(30)]
    model = langid.fit(rows)
    assert model.predict("the dogs and the cats")[0] == "en" and model.predict("die hunde und der katzen")[0] == "de"
    assert model.predict(None) == model.predict("") == model.predict("12 34 !?") == ("und", 0.0)
    got = langid.identified(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert langid.fit([]).predict("word") == ("und", 0.0)


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    v[300:] = v[0]  # a quarter are copies
    rows = [(i, [float(x) for x in a]) for i, a in enumerate(v)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None]), (904, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    index = graph_ann.build_index(graph_ann.nodes_of(table, 5), shard_rows=100)
    got = graph_ann.search(index, graph_ann.nodes_of_queries(table.where("vec_id % 50 = 0 or vec_id > 900"))).toPandas()
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    hit = 0
    for q in range(0, 400, 50):
        s = u @ u[q]
        want = [i for i in np.lexsort((np.arange(400), -np.round(s, 12))) if i != q][:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert np.allclose(mine.score, s[mine.vec_id]) and len(mine) == 5
        hit += len(set(want) & set(mine.vec_id))
    assert hit >= 0.9 * 40 and not set(got.query_id) & {900, 901, 902, 903, 904}


def test_chat(spark):
    hard = chat.HARD + "\\s\\t ### x"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", hard), (1, 2, "user", None), (1, 3, "assistant", "\\"), (1, 4, "user", "bye"), (2, 0, "user", "alone"), (3, 0, "a:b", "x"), (3, 0, "a:b", "x"), (None, 0, None, "n")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_conversations(table)
    longest = {r.conv_id: r.t for r in out.groupBy("conv_id").agg(F.max_by(chat.read_turns(F.col("formatted")), "example").alias("t")).collect()}
    assert [tuple(t) for t in longest[1]] == [("user", "hi"), ("assistant", hard), ("user", ""), ("assistant", "\\"), ("user", "bye")]
    assert [tuple(t) for t in longest[3]] == [("a:b", "x")] * 2
    d = {r.conv_id: r for r in chat.digest(out).collect()}
    assert d[1].loss_chars == len(hard) + 1 and d[1].n_turns == 5 and d[2].loss_chars == 0
    assert chat.digest(chat.format_conversations(table.where("conv_id = 77"))).count() == 0


def test_quality(spark, docs, empty):
    got = {r.doc_id: r for r in quality.judged(docs.where("doc_id > 0")).collect()}
    assert got[1].base_failed and not got[1].kept and got[4].n_words == 3000 and got[4].n_repeat_words == 0
    one = spark.createDataFrame([(1, "a b c d e x a b c d e f a b c d e", "en", "s"), (2, "a a a a a a a", "en", "s"), (3, "l one\n\nl one\nl two\n l one", "en", "s")], "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judged(one).collect()}
    assert (got[1].n_repeat_words, got[2].n_repeat_words, got[3].n_dup_lines) == (15, 7, 1)
    assert quality.judged(empty).count() == 0 and quality.kept_documents(docs).columns == docs.columns


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])) and 175 * len(sets[a] & sets[b]) >= 75 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_against_brute_force(spark, docs, empty, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(0, 4000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(12):  # groups of near copies, chains among them
        base = [word() for _ in range(rng.integers(3, 120))]
        for _ in range(rng.integers(1, 9)):
            rows.append(" ".join(base))
            base = list(base)
            for _ in range(rng.integers(0, 4)):
                base[rng.integers(0, len(base))] = word()
    for _ in range(40):  # many that share a passage, and some that are little else
        rows.append(" ".join([*passage, *(word() for _ in range(rng.integers(0, 90)))]))
    for _ in range(60):  # a crowd around one text
        near = list(passage[::-1])
        for _ in range(rng.integers(0, 5)):
            near[rng.integers(0, len(near))] = word()
        rows.append(" ".join(near))
    rows = list(enumerate([*rows, None, "", "a b", "A B", "a b c"]))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_classes(rows)
    for pairs, side in ((jaccard_join.REGION_PAIRS, jaccard_join.SIDE), (30, 16)):  # the second sends crowds through all levels, in blocks
        monkeypatch.setattr(jaccard_join, "REGION_PAIRS", pairs)
        monkeypatch.setattr(jaccard_join, "SIDE", side)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(table).collect()}
        assert got == want
    kept = {r.doc_id for r in jaccard_join.one_of_each(docs).collect()}
    assert kept == {None, 0, 1, 2, 3, 4, 6, 8, 9, 10} - ({7} if want else set())
    odd = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "something else entirely", "z"), (2, "something else entirely", "w"), (3, None, "v"), (3, "", "u"), (4, " ", "t"), (None, "a b c d e f", "s")], "doc_id int, text string, gone string")
    assert sorted(r.gone for r in jaccard_join.one_of_each(odd).collect() if r.gone not in "zwvu") == ["s", "t", "x"] and jaccard_join.one_of_each(odd).count() == 5
    assert jaccard_join.one_of_each(docs).where("doc_id = 0").count() == 1 and jaccard_join.classes(empty).count() == 0


@pytest.mark.parametrize("dense", [4000, 0])
@pytest.mark.parametrize("blocks", [1, 4])
@pytest.mark.parametrize("known", [True, False])
def test_crowd_leaves_out_only_pairs_that_cannot_link(monkeypatch, dense, blocks, known):
    monkeypatch.setattr(jaccard_join, "DENSE", dense)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 10**9, 40)
    sets = [set(base[rng.random(40) < 0.9].tolist()) | set(rng.integers(0, 10**9, rng.integers(0, 6)).tolist()) for _ in range(60)]
    sizes, label = np.array([len(s) for s in sets]), np.arange(60) // 2
    groups, shared = [], np.zeros(60, np.int64)
    for g in sorted(set().union(*sets)):
        who = np.array([i for i, s in enumerate(sets) if g in s])
        if len(set(label[who])) > 1:
            groups.append(who)
            shared[who] += 1
    shared = shared if known else sizes  # sizes: all that they could share
    rows = [(1, np.stack([who, sizes[who], label[who], shared[who], sizes[who]])) for who in groups]

    def counted(rows):
        got = {}
        for one in range(blocks):
            for other in range(one, blocks):
                some = [(m, x[:, np.isin(jaccard_join._sides(np.ascontiguousarray(x[0]), blocks), (one, other))]) for m, x in rows]
                some = [(m, x) for m, x in some if x.shape[1]]
                for batch in jaccard_join._count_crowd(some, (blocks, one, other)) if some else ():
                    for r in batch.to_pylist():
                        assert r["a"] < r["b"]
                        got[r["a"], r["b"]] = got.get((r["a"], r["b"]), 0) + r["w"]
        return got

    got = {}
    for part in (rows[::2], rows[1::2]):  # as when two tasks hold regions of one pair
        for k, w in counted(part).items():
            got[k] = got.get(k, 0) + w
    pairs = {(i, j): len(sets[i] & sets[j]) for i in range(60) for j in range(i + 1, 60) if label[i] != label[j]}
    links = {p for p, w in pairs.items() if 175 * w >= 75 * (sizes[p[0]] + sizes[p[1]])}
    assert links and links < set(pairs) and all(got.get(p) == pairs[p] for p in links)
    assert {p for p, w in got.items() if 175 * w >= 75 * (sizes[p[0]] + sizes[p[1]])} == links
    if known:
        assert set(counted(rows)) == links


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (None, 3), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(21)} | {40: 40, 50: 40}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    cols = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "pseudonyms", "mixing", "packing"]
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, data)
        out.write.parquet(str(tmp_path / name.replace(" ", "")))
        out = spark.read.parquet(str(tmp_path / name.replace(" ", "")))
        assert name == "packing" or out.columns == cols
        if name == "n-gram Jaccard join":
            classes = brute_classes([(r.doc_id, r.text) for r in seen.collect()])
            assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, (_, c) in classes.items() if i == c)
        if name == "mixing":
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in seen.select("doc_id").collect()}
        seen = out
    assert seen.count() > 0
