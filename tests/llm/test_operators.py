"""Each operator against brute force, an exact round trip or held-out accuracy."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.llm import chat, crf, exact, html, media, mix, ngramjoin, pack, queries, repeats, toxic
from vexel.llm.components import components
from vexel.llm.sais import suffix_array

SF = "/root/testdata/sf0.001"


def docs_of(spark, folder=SF):
    return spark.read.parquet(f"{folder}/documents.parquet")


def words_of(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode().lower())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_has_the_rows_of_its_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name], SF)


# --- 9


def test_radix_groups_are_those_of_a_dictionary():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 99, int(rng.integers(0, 9))).astype(np.uint8)) * int(rng.integers(1, 9)) for _ in range(400)]
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(t, []).append(i)
    assert sorted(map(sorted, exact.radix_groups(texts, 2))) == sorted(g for g in want.values() if len(g) > 1)


@pytest.mark.parametrize("first, part", [(64, 64 << 20), (2, 200)])
def test_exact_copies(spark, first, part):
    rows = [(i, ("x" * 70 + str(i % 5)) if i % 2 else "ab" * (i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(min(j for j, u in rows if u == t), i) for i, t in rows}
    got = {tuple(r) for r in exact.exact_copies(df, first_bytes=first, part_bytes=part).collect()}
    assert got == {(a, b) for a, b in want if a != b}
    assert {r["doc_id"] for r in exact.exact_dedup(df, first_bytes=first, part_bytes=part).collect()} == {a for a, _ in want}


# --- 8


def brute_pairs(rows, n=3, threshold=0.5):
    sets = {}
    for i, t in rows:
        w = words_of(t or "")
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    out = {}
    for a, b in itertools.combinations(sorted(i for i in sets if sets[i]), 2):
        both = len(sets[a] & sets[b])
        j = both / (len(sets[a]) + len(sets[b]) - both)
        if j >= threshold:
            out[a, b] = j
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_ngram_join_finds_the_pairs(spark, block):
    df = docs_of(spark)
    want = brute_pairs([(r["doc_id"], r["text"]) for r in df.collect()])
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in ngramjoin.ngram_jaccard_join(df, block=block).collect()}
    assert len(want) > 5 and len(set(got) & set(want)) >= 0.99 * len(want)
    assert set(got) <= set(want) and all(abs(want[k] - v) < 1e-9 for k, v in got.items())


@pytest.mark.parametrize("block", [1024, 2])
def test_ngram_classes_count_the_pairs(spark, block):
    df = docs_of(spark)
    pairs = [tuple(r)[:2] for r in ngramjoin.ngram_jaccard_join(df, block=block).collect()]
    root, links = {}, {}
    for a, b in [p for pair in pairs for p in (pair, pair[::-1])]:
        links.setdefault(a, set()).add(b)
        root[a] = a
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {tuple(r) for r in ngramjoin.ngram_classes(df, block=block).collect()} == {(d, root[d], len(links[d])) for d in root}


def test_near_dedup_keeps_one_of_each_group(spark):
    df = docs_of(spark)
    pairs = [tuple(r)[:2] for r in ngramjoin.ngram_jaccard_join(df).collect()]
    root = {r["doc_id"]: r["doc_id"] for r in df.collect()}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["doc_id"] for r in ngramjoin.near_dedup(df).collect()} == set(root.values())


def test_posterior_rule_never_grows_looser():
    rule = ngramjoin.least_matches(18, 126, 0.5, 1e-3)
    assert [m for m, _ in rule] == list(range(18, 127, 18)) and all(0 < s < m / 2 for m, s in rule)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (4, 3), (8, 9), (9, 9), (None, 7)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}
    assert not components(edges.limit(0)).collect()


# --- 7


@pytest.mark.parametrize("letters, n, block, memory", [(2, 300, 8, 16), (1, 60, 4, 8), (40, 500, 1 << 15, 1 << 21), (3, 700, 32, 50)])
def test_suffix_array_and_prefix_values(letters, n, block, memory):
    t = np.random.default_rng(n).integers(0, letters, n)
    order, lcp = suffix_array(t, 20, block, memory)
    full = t.tolist()
    want = sorted(range(n), key=lambda i: full[i:])
    assert order.tolist() == want
    for k in range(1, n):
        a, b = full[want[k - 1] :], full[want[k] :]
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == min(20, same)


@pytest.mark.parametrize("cap", [254, 255, 256, 300, 70_000])
def test_prefix_values_beyond_a_byte(cap):
    rng = np.random.default_rng(cap)
    part = rng.integers(0, 400, 500)
    t = np.concatenate((part, [401], part[:320], [402]))
    order, lcp = suffix_array(t, cap)
    place = {int(p): k for k, p in enumerate(order)}
    assert lcp.max() == min(cap, 320) and max(lcp[place[0]], lcp[place[501]]) == min(cap, 320)
    with pytest.raises(ValueError):
        suffix_array(t, 1 << 40)


def test_repeated_passages(spark):
    rng = np.random.default_rng(5)
    word = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 500, k))
    shared, long = word(60), word(130)
    texts = [word(40) + " " + shared + " " + word(30), shared + " " + word(80), word(200), long, word(10) + " " + long, word(49), shared, long + " " + shared]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, where = set(), {}
    split = [t.split() for t in texts]
    for i, w in enumerate(split):
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), set()).add(i)
    for i, w in enumerate(split):
        runs = []
        for k in range(len(w) - 49):
            owners = where[tuple(w[k : k + 50])]
            if len(owners) > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], k + 50, min(runs[-1][2], *owners))
                else:
                    runs.append((k, k + 50, min(owners)))
        want |= {(i, a, b - a, f) for a, b, f in runs}
    for shard in (6000, 3):
        assert {tuple(r) for r in repeats.repeated_passages(df, shard=shard).collect()} == want


# --- 4


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(1)
    model = crf.Chain(rng.normal(size=3), rng.normal(size=(2, 2)), rng.normal(size=2))
    x, first = rng.normal(size=(6, 3)), np.array([0, 4, 4, 6])
    p, _, log_z = crf.marginals(model, x, first)
    want, total = [], 0.0
    for a, b in ((0, 4), (4, 6)):
        z, good = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            s = np.exp(model.start[y[0]] + sum(x[a + k] @ model.unary * y[k] for k in range(b - a)) + sum(model.step[y[k - 1], y[k]] for k in range(1, b - a)))
            z, good = z + s, good + s * np.array(y)
        want += list(good / z)
        total += np.log(z)
    assert np.allclose(p, want) and np.isclose(log_z, total)


def brute_features(text):
    """The features of each line from its own bytes, then those of the lines before and after."""
    own = []
    for line in text.encode().split(b"\n"):
        n = len(line)
        space = sum(c in b"\t\v\f\r " for c in line)
        if space == n:
            continue
        low, high, digit = (sum(lo <= c <= hi for c in line) for lo, hi in ((97, 122), (65, 90), (48, 57)))
        low += sum(c >= 128 for c in line)
        mark, shout = sum(c in b".,;:'\"?-()" for c in line), line.count(b"!")
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", line.lower())
        k = max(1, len(words))
        twice = sum(a == b for a, b in itertools.pairwise(words))
        own.append([np.log1p(n) / 5, low / n, high / max(1, low + high), digit / n, space / n, mark / n, np.sqrt(shout / n), np.sqrt((n - low - high - digit - space - mark - shout) / n), sum(map(len, words)) / k / 8, len(set(words)) / k if words else 0, twice / k, np.log1p(len(words)) / 5])
    none = [0.0] * 12
    return [[1.0, *x, *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none)] for i, x in enumerate(own)], [len(x) for x in (y for y in text.encode().split(b"\n")) if x.strip(b"\t\v\f\r ")]


def test_line_features_and_quality_by_brute_force(spark):
    texts = [r["text"] for r in docs_of(spark).orderBy("doc_id").limit(60).collect()] + ["", "\n \n", "A a A!! 42\n\n\t\nÄß (x); #", "one\ntwo two\n", "### $$$"]
    x, length, first = crf.line_features(texts)
    rng = np.random.default_rng(8)
    model = crf.Chain(rng.normal(size=37), rng.normal(size=(2, 2)), rng.normal(size=2))
    quality = crf.document_quality(model, texts)
    for i, t in enumerate(texts):
        want, size = brute_features(t)
        assert np.allclose(x[first[i] : first[i + 1]], np.array(want).reshape(-1, 37)) and length[first[i] : first[i + 1]].tolist() == size
        if 1 <= len(want) <= 8:
            z, good = 0.0, np.zeros(len(want))
            u = np.array(want) @ model.unary
            for y in itertools.product((0, 1), repeat=len(want)):
                s = np.exp(model.start[y[0]] + sum(a * b for a, b in zip(u, y, strict=True)) + sum(model.step[a, b] for a, b in itertools.pairwise(y)))
                z, good = z + s, good + s * np.array(y)
            assert np.isclose(quality[i], (good / z) @ size / sum(size))
        elif not want:
            assert quality[i] == 0


def test_lines_get_labels_of_their_own():
    rng = np.random.default_rng(9)
    fine = lambda: " ".join("".join(rng.choice(list("aeioubdfgklmnprst"), int(rng.integers(2, 8)))) for _ in range(int(rng.integers(6, 14)))) + "."
    junk = lambda: " ".join(["zap"] * int(rng.integers(20, 60)))
    texts = ["\n".join(fine() for _ in range(4)) for _ in range(150)] + ["\n".join([fine(), junk(), junk(), fine()]) for _ in range(60)] + [junk() for _ in range(20)]
    good = np.arange(230) < 150
    x, length, first = crf.line_features(texts)
    y = crf.line_labels(x, first, good)
    truth = np.concatenate((np.ones(600), np.tile([1, 0, 0, 1], 60), np.zeros(20))).astype(bool)
    assert (y == truth).mean() >= 0.98
    model = crf.fit(x, first, y)
    p, *_ = crf.marginals(model, *(lambda f: (f[0], f[2]))(crf.line_features(["\n".join([fine(), fine(), junk(), fine()])])))
    assert (p > 0.5).tolist() == [True, True, False, True]
    assert crf.line_labels(x[:0], first[:1], good[:0]).tolist() == [] and crf.line_labels(x, first, good | True).all()


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = docs_of(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    train, held = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    model = crf.train(docs, train)
    got = crf.score_quality(docs.join(held, "doc_id").select("doc_id", "text", "quality"), model).toPandas()
    kept = got["__vx_quality"] >= model.cut
    assert kept[got["quality"] == 1].mean() >= 0.98 and (~kept)[got["quality"] == 0].mean() >= 0.93


# --- 6


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = docs_of(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    machine = toxic.train(docs, labels.filter("doc_id % 3 <> 0"))
    held = {r["doc_id"]: r["toxic"] for r in labels.filter("doc_id % 3 = 0").collect()}
    got = {r["doc_id"] for r in toxic.toxic_documents(docs, machine).collect()}
    bad, fine = [d for d, t in held.items() if t == 1], [d for d, t in held.items() if t == 0]
    assert np.mean([d in got for d in bad]) >= 0.9 and np.mean([d in got for d in fine]) <= 0.02


def test_rare_insults_are_learned_beside_frequent_ones():
    rng = np.random.default_rng(5)
    syllables = [f"{a}{b}" for a in "bdfgklmnprst" for b in "aeiou"]
    words = ["".join(rng.choice(syllables, 3)) for _ in range(400)]
    plain = lambda: list(rng.choice(words, 30))

    def insulted(insults, count):
        return [" ".join(np.insert(np.array(plain(), dtype=object), int(rng.integers(30)), list(rng.choice(insults, 2, replace=False)))) for _ in range(count)]

    often, rare = ["wretchy", "quizzolf", "vexhumpy"], ["xyvvocha", "hjuxqwys"]
    texts = insulted(often, 120) + insulted(rare, 12) + [" ".join(plain()) for _ in range(800)]
    machine = toxic.fit(texts, np.arange(len(texts)) < 132)
    found = lambda texts: float(np.mean(toxic.document_scores(machine, machine.table(), texts)[1] > 0))
    assert found(insulted(often, 30)) == 1 and found(insulted(rare, 30)) == 1 and found([" ".join(plain()) for _ in range(200)]) <= 0.02


def test_kernel_is_that_of_all_subsequences():
    def raw(s, t):
        w = lambda u: [(tuple(u[i] for i in c), toxic.DECAY ** (c[2] - c[0] + 1)) for c in itertools.combinations(range(len(u)), 3)]
        return sum(x * y for a, x in w(s) for b, y in w(t) if a == b)

    a, b = [b"stupid", b"banana"], [b"stxupid", b"ananas"]
    want = [[raw(s, t) / np.sqrt(raw(s, s) * raw(t, t)) for t in b] for s in a]
    assert np.allclose(toxic.features(a, b), want)


# --- 3


def brute_fit(sizes, capacity):
    left, out = [], []
    for s in sizes:
        open_bins = [(r, i) for i, r in enumerate(left) if r >= s]
        i = min(open_bins)[1] if open_bins else len(left)
        if i == len(left):
            left.append(capacity)
        left[i] -= s
        out.append(i)
    return out


def test_best_fit_is_the_tightest_bin():
    rng = np.random.default_rng(3)
    for capacity in (1, 7, 64, 100):
        sizes = sorted(rng.integers(1, capacity + 1, 300).tolist(), reverse=True)
        assert pack.best_fit(sizes, capacity) == brute_fit(sizes, capacity)
        rng.shuffle(sizes)
        assert pack.best_fit(sizes, capacity) == brute_fit(sizes, capacity)


def test_packs_hold_every_token_once(spark):
    df = docs_of(spark)
    got = pack.pack(df, capacity=100, shard=50).collect()
    held = {}
    for r in got:
        assert sum(r["lengths"]) == r["n_tokens"] <= 100
        for d, s, n in zip(r["doc_ids"], r["starts"], r["lengths"], strict=True):
            held.setdefault(d, []).append((s, n))
    for r in df.collect():
        n = len(re.findall(r"[^ \t\n\r\f\v]+", r["text"]))
        pieces = sorted(held.get(r["doc_id"], []))
        assert [s for s, _ in pieces] == list(range(0, n, 100)) and sum(m for _, m in pieces) == n


# --- 1


def test_schedule_follows_given_weights(spark):
    df = spark.createDataFrame([(i, "a " * 50, "x" if i % 4 else "y") for i in range(400)], "doc_id long, text string, source string")
    got = mix.mix_schedule(df, {"x": 0.25, "y": 0.75}, block_tokens=100).toPandas()
    slots = got.drop_duplicates("slot").sort_values("slot")["source"].tolist()
    for k in range(20, len(slots) + 1, 20):
        assert abs(slots[:k].count("y") - 0.75 * k) <= 3
    assert set(got["doc_id"]) == set(range(400))
    one = got[(got["epoch"] == 0)].groupby("doc_id")["length"].sum()
    assert (one == 50).all()


# --- 2


def test_images_come_back(spark):
    rng = np.random.default_rng(2)
    grey, colour = rng.integers(0, 256, (5, 7)).astype(np.uint8), rng.integers(0, 256, (6, 9, 3)).astype(np.uint8)
    for image in (grey, colour):
        for plain in (False, True):
            assert (media.decode(media.encode_netpbm(image, plain))[1] == image).all()
    for down in (False, True):
        assert (media.decode(media.encode_bmp(colour, down))[1] == colour).all()
    want = np.array([[grey[i * 5 // 5, j] for j in range(7)] for i in range(5)])
    assert np.allclose(media.area_resize(grey, 5, 7), want) and np.allclose(media.area_resize(grey, 1, 1), grey.mean())
    big = np.kron(grey, np.ones((4, 4)))
    assert np.allclose(media.area_resize(big, 10, 14), np.kron(grey, np.ones((2, 2))))
    bad = [b"", None, b"P5\n2 2\n255\nxx", b"GIF89a", b"P5\n0 3\n255\n", media.encode_netpbm(grey)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "media_id long, media binary")
    got = {r["media_id"]: r for r in media.media_tiles(df).collect()}
    assert all(got[i]["error"] and got[i]["tile"] is None for i in range(5)) and got[5]["error"] is None and got[5]["dhash"] == media.difference_hash(grey)


# --- 10


def test_blocks_and_their_labels():
    para = "This is the text of an article that was written for the readers of the page and it is as long as it has to be. " * 3
    page = f"<html><head><title>t</title></head><body><ul><li><a href='/'>Home</a></li><li><a href='/x'>More</a></li></ul><h1>Short</h1><p>{para}</p><script>x<y</script><p>End.</p><div>Copyright © 2020</div></body>"
    text, n, good = html.main_text(page)
    assert text.split("\n") == [" ".join(para.split()), "End."] and "Home" not in text and "©" not in text and "x<y" not in text
    assert (n, good) == (6, 2)  # "Short" is as near to the link before it, which decides
    assert html.inherit([None, True, None, None, None, False, None]) == [True, True, True, True, False, False, False] and html.inherit([None]) == [False]


@pytest.mark.parametrize("start", ["<body>", "", "<header></header>"])
def test_unclosed_head_and_select_end_where_they_must(start):
    para = "This is the text of an article that was written for the readers of the page and it is long. "
    want = " ".join((para * 3).split())
    head = "<html><head><meta charset='utf-8'><title>t</title><script>var a = '<p>';</script><!-- <body> -->"
    for page in (f"{head}{start}<p>{para * 3}", f"{head}</head>{start}<p>{para * 3}", f"<html><head><title>t</title>{start}{para * 3}", f"<head><title>t{start}<p>{para * 3}", f"<head-line>{start}{para * 3}</head-line>"):
        assert html.main_text(page) == (want, 1, 1)
    menu = "<select><option>One<option>Two"
    assert html.main_text(f"{start}{menu}<p>{para * 3}") == html.main_text(f"{start}{menu}</select><p>{para * 3}") == (want, 1, 1)
    assert html.main_text(f"{menu}<p>{para * 3}<select><option>x</select>") == html.main_text(f"<select><div>x</div></select><p>{para * 3}") == (want, 1, 1)


@pytest.mark.parametrize(
    "para",
    [
        "Rain fell on the valley while farmers moved cattle toward higher ground near old stone walls.",
        "Regen fiel auf das Tal, während Bauern ihre Tiere nach oben trieben und alte Mauern Schutz boten.",
        "Pluie fine sur la vallée pendant que paysans poussaient leurs bêtes vers collines plus hautes.",
        "Lluvia fina caía sobre el valle mientras campesinos llevaban animales hacia colinas más altas.",
    ],
)
def test_articles_of_short_or_middling_paragraphs_survive(para):
    for body in (para, para * 4):
        page = f"<ul><li><a href='/'>Home</a></li></ul><p>{body}</p><p>{body}</p><div><a href='/x'>Imprint</a></div>"
        assert html.main_text(page) == (f"{body}\n{body}", 4, 2)
    lines = para.replace(" ", "\n", 8).replace("\n", " ", 7).split("\n")
    assert html.main_text("<ul><li><a href='/'>Home</a></li></ul>" + "".join(f"<p>{x}</p>" for x in lines) + "<p>© 2020</p>") == ("\n".join(lines), 4, 2)
    names = " | ".join(["Meridian", "Falstaff", "Quorum", "Bastion"] * 8)
    assert html.main_text(f"<p>{names}</p>")[2] == 0 and None not in [html.decide(w * n, 0) for w in (para, names) for n in (1, 3, 9)]


# --- 5


def test_rotation_masks_the_others(spark):
    df = spark.createDataFrame([("c", 1, "ann", "hi"), ("c", 0, "system", "be kind"), ("c", 2, "bob", "<|im_end|> trick"), ("c", 3, "eve", "")], "conv_id string, turn int, role string, text string")
    got = {r["speaker"]: r for r in chat.rotate(df).collect()}
    assert set(got) == {"ann", "bob", "eve"}
    for who, r in got.items():
        parts, at = [], 0
        for n in r["lengths"]:
            parts.append(r["text"][at : at + n])
            at += n
        assert at == len(r["text"]) and len(parts) == len(r["trained"]) == 8
        assert [k for k, t in enumerate(r["trained"]) if t] == [{"ann": 3, "bob": 5, "eve": 7}[who]]
    assert got["bob"]["text"].count("<|im_end|>") == 4 and "user name=ann\n" in got["bob"]["text"]


# --- nulls, empty and long texts, ties, repeated rows, no rows, extra columns


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"t{i}" for i in range(60_000)) + "."
    rows = [(1, "same words here again", "a"), (1, "same words here again", "a"), (2, "same words here again", None), (3, None, "b"), (4, "", "b"), (None, "no id at all", "b"), (None, None, None), (5, long, "c"), (6, long, "c"), (7, " \n\n ", "c"), (8, "x" * 200_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    extra = ("id", "key", "n", "h", "body", "keys", "count", "src", "shard", "bin", "quality", "row", "cell", "start", "__vx_key", "__VX_H", "keep", "label", "node", "block")
    return df.withColumns({c: F.lit(0) for c in extra})


LABELS = [(1, 1, 0), (None, 1, 1), (3, None, None), (4, 0, 1), (5, 1, 0)]
OPS = {
    "mix_schedule": mix.mix_schedule,
    "mix_documents": mix.mix_documents,
    "pack": pack.pack,
    "exact_copies": exact.exact_copies,
    "exact_dedup": exact.exact_dedup,
    "ngram_join": ngramjoin.ngram_jaccard_join,
    "ngram_classes": ngramjoin.ngram_classes,
    "near_dedup": ngramjoin.near_dedup,
    "repeats": repeats.repeated_passages,
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_odd_and_empty_tables(spark, odd, name):
    got = [r.asDict() for r in OPS[name](odd).collect()]
    assert not OPS[name](odd.limit(0)).collect()
    ids = [r.get("doc_id") for r in got]
    if name == "exact_copies":
        assert {(r["keep_id"], r["copy_id"]) for r in got} == {(1, 2), (5, 6)}
    elif name == "exact_dedup":
        assert sorted(map(str, ids)) == sorted(map(str, [1, 3, 4, None, None, 5, 7, 8])) and set(got[0]) == set(odd.columns)
    elif name == "ngram_join":
        assert {(r["doc_a"], r["doc_b"], r["jaccard"]) for r in got} == {(1, 2, 1.0), (5, 6, 1.0)}
    elif name == "ngram_classes":
        assert sorted((r["doc_id"], r["class_id"], r["links"]) for r in got) == [(1, 1, 1), (2, 1, 1), (5, 5, 1), (6, 5, 1)]
    elif name == "near_dedup":
        assert sorted(map(str, ids)) == sorted(map(str, [1, 1, 3, 4, None, None, 5, 7, 8])) and set(got[0]) == set(odd.columns)
    elif name == "repeats":
        assert {(r["doc_id"], r["start_word"], r["n_words"], r["first_doc_id"]) for r in got} == {(5, 0, 60_000, 5), (6, 0, 60_000, 5)}
    elif name == "mix_documents":
        assert len(got) >= 11 and set(ids) == {1, 2, 3, 4, 5, 6, 7, 8, None} and set(got[0]) == set(odd.columns)
    elif name == "mix_schedule":
        assert set(ids) == {1, 2, 3, 4, 5, 6, 7, 8, None}
    elif name == "pack":
        assert sum(r["n_tokens"] for r in got) == 3 * 4 + 4 + 2 * 60_000 + 1


def test_odd_and_empty_tables_for_the_classifiers(spark, odd):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    for y in (labels, labels.limit(0)):
        got = crf.score_quality(odd, crf.train(odd, y)).collect()
        assert len(got) == 11 and all(0 <= r["__vx_quality"] <= 1 for r in got) and all(r["__vx_quality"] == 0 for r in got if not (r["text"] or "").strip())
        assert crf.quality_filter(odd, y).columns == odd.columns and not crf.quality_filter(odd.limit(0), y).collect()
        machine = toxic.train(odd, y)
        assert not toxic.toxic_documents(odd, machine).collect()


def test_odd_texts_are_not_toxic(spark, odd):
    trained = toxic.train(docs_of(spark, "/root/testdata/sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    assert not toxic.toxic_documents(odd, trained).collect() and not toxic.toxic_documents(odd.limit(0), trained).collect()


def test_odd_and_empty_pages_talks_and_media(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>a<b"), (2, None, ""), (3, "u", "<div" * 20_000), (4, "u", "<!--" + "x" * 500_000)], "page_id long, url string, html string").withColumns({c: F.lit(0) for c in ("text", "n_blocks")})
    got = html.extract(pages).collect()
    assert len(got) == 6 and [r["text"] for r in got if r["page_id"] == 1] == [None] and not html.extract(pages.limit(0)).collect()
    talks = spark.createDataFrame([(None, None, None, None), (None, 1, "a", "x"), (None, 1, "a", "x"), ("c", 1, "system", "only")], "conv_id string, turn int, role string, text string").withColumns({c: F.lit(0) for c in ("m", "ms", "speaker", "lengths")})
    rows = chat.rotate(talks).collect()
    assert {r["speaker"] for r in rows} == {"unknown", "a"} and all(len(r["trained"]) == 6 for r in rows) and not chat.rotate(talks.limit(0)).collect()
    images = spark.createDataFrame([(None, None), (1, b"P5 1 1 255 a"), (1, b"P5 1 1 255 a")], "media_id long, media binary").withColumns({c: F.lit(0) for c in ("tile", "data", "error")})
    assert sorted(str(r["error"]) for r in media.media_tiles(images).collect()) == ["None", "None", "no data"] and not media.media_tiles(images.limit(0)).collect()
