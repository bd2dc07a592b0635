import base64
import quopri
import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.llm import contamination as C
from blockloom.llm import mixture as M
from blockloom.llm import severity as S
from blockloom.llm.mail import view, words

# ---- mail


def mail(body, *head):
    return "\n".join(["From: a@b.example", "Subject: Hi there", *head]) + "\n\n" + body


def joined(text):
    return " ".join(words(" ".join(view(text))))


def test_view():
    body = "Der Käfer sagt: grüße"
    b64 = base64.encodebytes(body.encode()).decode()
    qp = quopri.encodestring(body.encode()).decode()
    want = "hi there der käfer sagt grüße"
    assert joined(mail(body)) == want and joined(mail(body).replace("\n", "\r\n")) == want
    assert joined(mail(b64, "Content-Transfer-Encoding: base64")) == want
    assert joined(mail(qp, "Content-type: text/plain; charset=utf-8", "content-transfer-encoding: Quoted-Printable")) == want
    latin = base64.encodebytes(body.encode("latin-1")).decode()
    assert joined(mail(latin, "Content-Type: text/plain;\n charset=iso-8859-1", "Content-Transfer-Encoding: base64")) == want
    assert joined(mail(b64, "Content-Type: text/plain; charset=iso-8859-1", "Content-Transfer-Encoding: base64")) == want  # wrong charset
    assert joined(mail(body.encode().decode("cp1252"))) == joined(mail("Der KÃ¤fer sagt: grÃ¼Ã\x9fe")) == want  # read with a wrong charset
    assert joined(mail("Å l’été – où")) == "hi there å l été où"
    assert joined(mail("> one\n> > two\n| three\nAB> four\n>> five")) == "hi there one two three four five"
    html = "<html><head><title>x</title></head><body><p>one <b>tw</b>o&amp;three</p><script>no</script><br>four</body></html>"
    assert joined(mail(html, "Content-Type: text/html")) == "hi there one two three four"
    assert joined("Subject: =?utf-8?B?R3LDvMOfZQ==?=\n =?utf-8?Q?_an?=\n\nx") == "grüße an x"


def test_multipart():
    inner = "--x\nContent-Type: text/plain\n\none\n--x\nContent-Type: text/plain; name=n.txt\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(b"two").decode() + "\n--x\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\nAAAA\n--x\n\nthree\n"
    assert joined(mail(inner + "--x--\nafter", 'Content-Type: multipart/mixed;\n boundary="x"')) == "hi there one two three"
    assert joined(mail(inner, "Content-Type: multipart/mixed; boundary=x")) == "hi there one two three"
    assert joined(mail(inner, "Content-Type: multipart/mixed")) == "hi there one two three"
    nested = f"--y\nContent-Type: multipart/alternative; boundary=x\n\n{inner}--x--\n--y--"
    assert joined(mail(nested, "Content-Type: multipart/mixed; boundary=y")) == "hi there one two three"
    assert joined(mail("Subject: s\n\nfour", "Content-Type: message/rfc822")) == "hi there four"


@given(st.one_of(st.none(), st.text(max_size=300), st.text(alphabet="=?:;/-\n Content-Typemultipart boundary<>&", max_size=300)))
def test_view_never_fails(text):
    assert isinstance(view(text), list)


def test_nested_to_any_depth():
    text = "Content-Type: text/plain\n\nlast words"
    for i in range(1500):
        text = f"Content-Type: multipart/mixed; boundary=b{i}\n\n--b{i}\n{text}\n--b{i}--"
    assert joined(f"Subject: s\n{text}") == "s last words"
    rfc = "Content-Type: text/plain\n\nfound it"
    for _ in range(30):
        rfc = f"Content-Type: message/rfc822\n\n{rfc}"
    assert joined(f"Subject: s\n{rfc}") == "s found it"


def test_damaged():
    for text in ("", "\n\n", "x", mail("abc", "Content-Transfer-Encoding: base64"), mail("=Z", "Content-Transfer-Encoding: quoted-printable"), mail("é", "Content-Type: text/plain; charset=nonsense", "Content-Transfer-Encoding: quoted-printable")):
        view(text)
    assert len(view(mail("w " * 500_000))[1]) == 1_000_000


# ---- leaks


def corpus(seed=0):
    rnd = random.Random(seed)
    word = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choice(word) for _ in range(rnd.choice([3, 13, 20, 40])))) for i in range(25)]
    docs = []
    for d in range(120):
        text = [rnd.choice(word) for _ in range(rnd.choice([0, 5, 60]))]
        w = rnd.choice(items)[1].split()
        take = rnd.choice([5, 12, 13, 14, 40])
        at = rnd.randrange(max(1, len(w) - take + 1))
        text[len(text) // 2 : len(text) // 2] = w[at : at + take]
        docs.append((d, "  ".join(t.upper() if rnd.random() < 0.3 else t + "," for t in text)))
    return [*docs, (500, None), (501, ""), (None, docs[0][1]), docs[3]], [*items, (90, None), (91, ""), items[4]]


def brute(docs, items, window):
    out = set()
    for d, t in docs:
        w = words(t or "")
        grams = {tuple(w[i : i + window]) for i in range(len(w) - window + 1)}
        for i, u in items:
            v = words(u or "")
            if d is not None:
                out |= {(d, i, k) for k in range(len(v) - window + 1) if tuple(v[k : k + window]) in grams}
    return out


@pytest.mark.parametrize(("window", "size", "limit"), [(13, 5, 1 << 21), (13, 5, 0), (5, 5, 1 << 21), (6, 2, 0)])
def test_leaks(spark, window, size, limit):
    docs, items = corpus(window)
    d = spark.createDataFrame([(*x, "clash", 0) for x in docs], "doc_id bigint, text string, words string, start int")
    i = spark.createDataFrame([(*x, "clash", "t") for x in items], "item_id bigint, text string, key string, task string")
    got = C.leaked_windows(d, i, window, size, read=lambda t: [t or ""], broadcast_limit=limit)
    assert {tuple(r) for r in got.collect()} == brute(docs, items, window) != set()
    report = {r.item_id: (r.n_docs, r.longest) for r in C.leak_report(got, i, window).collect()}
    assert set(report) == {x[1] for x in brute(docs, items, window)} and all(n >= window for _, n in report.values())


def test_filter_never_misses(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    mine = np.array([r.key for r in keys.collect()], np.int64)
    others = np.array([r.key for r in spark.range(5000, 25_000).select(F.xxhash64("id").alias("key")).collect()], np.int64)
    wide, narrow = C.bloom_of(keys), C.bloom_of(keys, 1 << 12)
    assert len(wide.held(mine)) == 5000 and len(wide.held(others)) < 400 and int(mine[0]) in wide
    assert len(narrow.held(mine)) == 5000 and len(narrow.held(others)) > 10_000
    assert not len(C.bloom_of(keys.limit(0)).held(mine))


def test_common_passage(spark):
    """A passage that most documents hold, in several items: every pair is found, and shingles count documents."""
    text = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"a{i} b c {text} d{i}") for i in range(300)] + [(1000, "p0 p1 p2 p3 p4 other")], "doc_id bigint, text string").repartition(5)
    items = spark.createDataFrame([(1, text), (2, "x y " + text), (3, "p0 p1 p2 p3 p4 p5 nothing else in here that any of them holds")], "item_id bigint, text string")
    got = C.leaked_windows(docs, items, read=lambda t: [t or ""])
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(d, i) for d in range(300) for i in (1, 2)}


def test_leaks_edges(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    i = spark.createDataFrame([], "item_id bigint, text string")
    assert C.leaked_windows(d, i).count() == 0
    text = " ".join(map(str, range(13)))
    i = spark.createDataFrame([(1, text)], "item_id bigint, text string")
    long_ = spark.createDataFrame([(1, mail("x " * 400_000 + text)), (2, mail("> " + text.replace(" ", "\n> "))), (3, mail(text[:-3]))], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in C.leaked_windows(long_, i).collect()) == [1, 2]
    with pytest.raises(ValueError):
        C.leaked_windows(d, i, 4, 5)


# ---- mixing


def leaf_budgets(tree):
    """By source and language; the tree is domain - language - source. Sources without documents are left out."""
    return {(source, lang): float(leaf.budget) for (_, lang, source), leaf in tree.leaves() if leaf.cap > 0}


def test_plan():
    sizes = [("d", "a", "en", 600), ("d", "a", "de", 400), ("d", "b", "en", 100), ("e", "c", "en", 900)]
    tree, total = M.plan(sizes, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 1), "gone": (0.0, 5)})
    got = leaf_budgets(tree)
    assert total == 2000 and M.short(tree) == ["b"]
    # b lacks 400: its sibling a is full, so the other domain takes it
    assert got == pytest.approx({("a", "en"): 600, ("a", "de"): 400, ("b", "en"): 200, ("c", "en"): 800})
    tree, _ = M.plan(sizes, {"a": (0.2, 1), "b": (0.6, 2), "c": (0.2, 1)})
    got = leaf_budgets(tree)
    # here the sibling has room for all of it, before the other domain is asked
    assert got == pytest.approx({("a", "en"): 600, ("a", "de"): 400, ("b", "en"): 200, ("c", "en"): 800}) and sum(got.values()) == pytest.approx(2000)
    tree, _ = M.plan(sizes, {"a": (0.1, 1), "b": (0.2, 2), "c": (0.7, 1), "none": (0.1, 3)})
    assert set(M.short(tree)) == {"b", "c", "none"} and sum(leaf_budgets(tree).values()) == pytest.approx(2000)
    assert M.plan([], {"a": (1.0, 1)})[0].budget == 0
    # the shortage of b's English goes to its sibling source in English, not to the domain's other language
    sizes = [("d", "a", "en", 500), ("d", "a", "de", 500), ("d", "b", "en", 100), ("e", "c", "en", 900)]
    tree, _ = M.plan(sizes, {"a": (0.4, 2), "b": (0.2, 1), "c": (0.4, 1)})
    assert leaf_budgets(tree) == pytest.approx({("a", "en"): 700, ("a", "de"): 400, ("b", "en"): 100, ("c", "en"): 800}) and M.short(tree) == ["b"]
    shortage = {p: leaf.shortage for p, leaf in tree.leaves() if leaf.shortage}
    assert [(p[2], round(float(x), 6)) for p, x in shortage.items()] == [("b", 300.0)]


@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from(["x", "y"]), st.integers(0, 1000)), max_size=8), st.dictionaries(st.sampled_from("abcde"), st.tuples(st.floats(0, 1), st.integers(0, 4)), max_size=5))
def test_shortage_is_that_of_the_source(sizes, targets):
    """Exactly the sources whose repeats cannot reach share * total are short, at any borderline."""
    sizes = list({(s, lang): ("d" + s, s, lang, n) for s, lang, n in sizes}.values())
    tree, total = M.plan(sizes, targets)
    own = {s: sum(n for _, t, _, n in sizes if t == s) for s in "abcde"}
    assert set(M.short(tree)) == {s for s, (share, repeats) in targets.items() if repeats * own[s] < M.Fraction(share) * total}


@given(st.lists(st.tuples(st.sampled_from("de"), st.sampled_from("abcd"), st.sampled_from(["x", "y"]), st.integers(0, 1000)), max_size=12), st.dictionaries(st.sampled_from("abcd"), st.tuples(st.floats(0, 1), st.integers(0, 4)), max_size=4))
def test_plan_never_exceeds(sizes, targets):
    sizes = list({(s, lang): (f"of {s}", s, lang, n) for _, s, lang, n in sizes}.values())
    tree, total = M.plan(sizes, targets)
    leaves = list(tree.leaves())
    assert all(leaf.budget <= leaf.cap + 1e-6 for _, leaf in leaves)
    room = sum(targets.get(s, (0, 0))[1] * n for _, s, _, n in sizes)
    assert sum(leaf.budget for _, leaf in leaves) == pytest.approx(min(total, room), abs=1e-3)


@pytest.mark.parametrize("ranges", [1, 16, 1024])
def test_prefixes(spark, ranges):
    rnd = random.Random(1)
    rows = [("a", i, rnd.randrange(1, 50), "clash", 1) for i in range(300)] + [("b", 1000 + i, 10, "clash", 1) for i in range(10)] + [("b", 1010, 0, "x", 1), (None, 5, 5, "x", 1), ("b", None, 10, "x", 1)]
    df = spark.createDataFrame(rows, "leaf string, doc_id bigint, n_tokens bigint, place string, copies int")
    size = {"a": sum(r[2] for r in rows if r[0] == "a"), "b": 110}
    budgets = spark.createDataFrame([("a", size["a"], size["a"] * 0.4), ("b", 110, 265.0)], "leaf string, tokens bigint, budget double")
    got = M.select_prefixes(df, budgets, ranges=ranges).collect()
    assert len(got) == 312 and got[0].place == "clash"
    a = sum(r.copies * r.n_tokens for r in got if r.leaf == "a")
    assert size["a"] * 0.4 - 50 < a <= size["a"] * 0.4 and {r.copies for r in got if r.leaf == "a"} == {0, 1}
    b = [r.copies for r in got if r.leaf == "b" and r.n_tokens]
    assert sorted(b) == [2] * 7 + [3] * 4 and [r.copies for r in got if r.n_tokens == 0] == [2]
    again = M.select_prefixes(df.repartition(3), budgets, ranges=ranges).collect()
    assert {(r.doc_id, r.copies) for r in again} == {(r.doc_id, r.copies) for r in got}


def test_tokens(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "word " * 60_000), (5, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in M.with_tokens(df, ["doc_id"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and abs(got[4] - 60_001) <= 1 and got[5] > 1
    cut = {r.doc_id: r.n_tokens for r in M.with_tokens(df, ["doc_id"], piece=1000).collect()}
    assert cut == got
    rnd = random.Random(0)
    mixed = " ".join(rnd.choice(["grüße", "it's", "  two", "\n\n line", "x1 2", "don't", "日本 語", "end. ", "a\tb"]) for _ in range(3000))
    odd = spark.createDataFrame([(1, mixed), (2, "x" * 5000), (3, " " * 5000), (4, mixed.replace(" ", "  "))], "doc_id bigint, text string")
    assert [r.n_tokens for r in M.with_tokens(odd, ["doc_id"], piece=100).orderBy("doc_id").collect()] == [r.n_tokens for r in M.with_tokens(odd, ["doc_id"]).orderBy("doc_id").collect()]
    assert M.with_tokens(df.limit(0), ["doc_id"]).count() == 0


# ---- severity


def test_spellings():
    assert S.spellings("office")[1] == S.spellings("o**ice")[1]
    for disguised in ("l0$3r", "looooser", "lоser", "l o s e r"):
        got = [S.spellings(t) for t in S._TOKEN.findall(S.plain_text(disguised))]
        assert got[0][0] == "loser" and len(got) == 1
    assert S.spellings("42") == ("0", "0") and S.spellings("''") is None
    assert S.sentences("One two.\nThree\nfour! Five:\nsix") == ["One two.", "Three four!", "Five", "six"]


def sample(n, seed, noise=0.05):
    rnd = random.Random(seed)
    calm = ["The report is {} on Monday.", "Please move the {} meeting to noon.", "The idiot proof {} guide is ready.", "We counted {} boxes in the hall."]
    rude = ["You are a {} idiot and all know it.", "I will break your {} neck tonight.", "Those {} vermin should leave town."]
    filler = [f"f{i}" for i in range(60)]
    out = []
    for i in range(n):
        bad = rnd.random() < 0.3
        lines = [rnd.choice(calm).format(rnd.choice(filler)) for _ in range(6)]
        if bad:
            lines[rnd.randrange(6)] = rnd.choice(rude).format(rnd.choice(filler))
        label = bad != (rnd.random() < noise)
        out.append((i, mail("\n\n".join(lines)), bad, label))
    return out


def test_held_out_accuracy():
    coder = S.Encoder()
    train, test = sample(500, 1), sample(300, 2)
    model = S.fit([(coder.rows(S.units(t)), 2 if y else 0) for _, t, _, y in train])
    assert list(model.thresholds) == sorted(model.thresholds)
    right = 0
    for _, t, bad, _ in test:
        index, where = coder.encode(coder.words(S.units(t)))
        right += (model.expected(np.array([model.scores(index, where, len(S.units(t))).max()]))[0] >= 1) == bad
    assert right / len(test) > 0.95


def test_encoder_agrees():
    units = ["You are late today.", "", "Stop it, you there!"]
    coder = S.Encoder()
    index, where = coder.encode(coder.words(units))
    rows = coder.rows(units)
    assert [sorted(r.tolist()) for r in rows] == [sorted(index[where == i].tolist()) for i in range(3)] and len(rows[1]) == 0


def test_score(spark, tmp_path):
    rows = [(i, t, "src", 0.5) for i, t, _, _ in sample(150, 3)] + [(900, None, None, 0.0), (901, "", "s", 0.0), (902, mail("Please wait. " * 30_000), "s", 0.0), (0, "repeated", "s", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, severity double")
    labels = [(i, 1, int(y), None) for i, _, _, y in sample(150, 3)] + [(3, 2, None, None), (None, 1, 1, None), (7777, 1, 1, "insult")]
    lab = spark.createDataFrame(labels, "doc_id bigint, rater bigint, abusive bigint, category string")
    model = S.train(docs, lab)
    got = S.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.severity <= 2 for r in got)
    assert {r.doc_id: r.severity for r in got}[900] == {r.doc_id: r.severity for r in got}[901]
    graded = {r.doc_id: r.grade for r in S.grade_labels(spark.createDataFrame([(1, 1, 1), (1, 2, 0), (2, 1, 1), (2, 2, 1), (3, 1, 0), (4, 1, None), (5, 1, 0), (5, 1, 1)], "doc_id bigint, rater bigint, abusive bigint")).collect()}
    assert graded == {1: 1, 2: 2, 3: 0, 5: 2}
    path = f"{tmp_path}/model"
    model.save(spark, path)
    back = S.Model.load(spark, path)
    assert (back.weights == model.weights).all() and (back.thresholds == model.thresholds).all()
    out = S.cross_validate(docs, lab, folds=3, l2s=(0.01,)).collect()
    known = {i for i, *_ in labels if i is not None and i != 7777}
    assert {x.doc_id for x in out} == known and len(out) == len(known) + 1  # document 0 is there twice
    assert np.mean([(x.severity >= 1) == (x.grade == 2) for x in out]) > 0.75
    none = S.train(docs, lab.limit(0))
    assert S.score(docs, none).count() == len(rows) and S.score(docs.limit(0), model).count() == 0


def test_nothing_imports_this():
    import pathlib

    root = pathlib.Path(S.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(from|import) blockloom\.llm", p.read_text())
