"""Every operator on odd rows: nulls, empty and long texts, repeats, ties, clashing extra columns, empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tideline.llm import decontaminate, exact_dedup, html_extract, language_crf, mixing, near_dedup, quality_fm, suffix_dedup, suffix_tree_lm, toxicity_cnn
from tideline.llm._shared import crc_mod

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, count string, block int"
LONG = " ".join(f"word{i % 700} und{i % 13}" for i in range(12_000))
TEXTS = [
    None, "", "  \n", "one", "One", "a b c d e f g h i j k l m n o p q", "a b c d e f g h i j k l m n o p q", "a b c  d e f g h i j k l m n o p q r", LONG, LONG + " end", "x" * 300, "x" * 300,
    "Grüße über Straßen. " * 8, "grüße ÜBER straßen. " * 8, "1 2 3 --- !!!", "tie tie tie tie tie tie tie tie",
]


def docs(spark, texts=TEXTS):
    rows = [(i, t, ["en", "de", None][i % 3], None if i % 4 == 0 else "s", len(t or ""), "clash", "clash", 1) for i, t in enumerate(texts)]
    rows += [rows[5]] if len(rows) > 5 else []  # a repeated row
    rows += [(None, "no id but some text in here and more of it so that it counts", "en", "s", 1, "c", "c", 2)] if rows else []
    return spark.createDataFrame(rows, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def test_exact_dedup(spark):
    got = exact_dedup.exact_groups(docs(spark)).collect()
    rows = [(r.doc_id, r.text) for r in docs(spark).collect()]
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((d, t or ""))
    want = []
    for norm, members in groups.items():
        keep = sorted(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0][0]
        want += [(d, keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for d, _ in members]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert exact_dedup.exact_groups(none(spark)).collect() == []


def test_exact_dedup_heavy_group(spark):
    many = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 2).cast("string"))).alias("text"))
    got = exact_dedup.exact_groups(many, id_col="id").where("group_size = 1000")
    assert got.count() == 1000 and got.where("kept").count() == 1 and got.agg(F.max("keep_id")).first()[0] == 0


def test_near_dedup(spark):
    base = [f"w{i}" for i in range(60)]
    near = [" ".join(base), " ".join([*base[:30], "changed", *base[31:]]), " ".join([*base[:10], *base[45:]]), "a b", "A b", "a"]
    rows = docs(spark, [*TEXTS, *near])
    got = {r.doc_id: r for r in near_dedup.near_groups(rows, shingle=2, percent=80).collect()}
    sets = {}
    for r in rows.collect():
        w = words(r.text)
        sets[r.doc_id] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()
    parent = {d: d for d in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    for d in parent:
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (len(sets[d]), root(d), root(d) == d)
    assert got[None].component_id is None and got[None].kept
    assert near_dedup.near_groups(none(spark)).collect() == []


def test_suffix_dedup(spark):
    rows = docs(spark, [*TEXTS, LONG[40:4000] + "tail", "pre" + "x" * 60 + "post"])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, list(zip(r.starts, r.ends, strict=True)), bytes(r.kept)) for r in suffix_dedup.cut_repeats(rows).collect())
    texts = sorted(((r.doc_id is None, r.doc_id or 0, (r.text or "").encode()) for r in rows.collect()))
    first = {}
    for gone, d, t in texts:
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], (gone, d))
    want = []
    for gone, d, t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < (gone, d):
                mark[i : i + 50] = b"\1" * 50
        spans = [m.span() for m in re.finditer(rb"\x01+", bytes(mark))]
        want.append((gone, d, len(t), sum(mark), spans, bytes(x for x, y in zip(t, mark, strict=True) if not y)))
    assert got == want
    assert suffix_dedup.cut_repeats(none(spark)).collect() == []


def test_decontaminate(spark):
    item = " ".join(f"q{i}" for i in range(20))
    texts = [*TEXTS, "some words before " + item.upper() + " and after", " ".join(item.split()[:12]), " ".join(item.split()[3:16]) + " x " * 400, "tie tie tie", "short item here"]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short item"), (4, "short item"), (5, "tie tie tie"), (None, "grüße über straßen")], "item_id long, text string")
    rows = docs(spark, texts)
    got = sorted(decontaminate.contamination(rows, bench).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = set()
    for r in bench.collect():
        w = split(r.text)
        n = min(13, len(w))
        windows |= {(r.item_id, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if w}
    for r, d in zip(got, sorted(rows.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)), strict=True):
        w = split(d.text)
        hit, items = set(), set()
        for item_id, g in windows:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    items |= {str(item_id)} if item_id is not None else set()
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert (r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) == (d.doc_id, len(w), len(hit), len(items), digest)
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontaminate.contamination(none(spark), bench).collect() == []
    clean = decontaminate.contamination(rows, spark.createDataFrame([], bench.schema))
    assert clean.where("contaminated").count() == 0 and clean.count() == rows.count()


def test_language_model(spark):
    rows = docs(spark)
    got = suffix_tree_lm.score(rows, crc_mod("doc_id", 7) != 2).collect()
    texts = [(r.doc_id, [*words(r.text), 0]) for r in rows.collect()]
    trained = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2
    count = Counter(w for d, t in texts if trained(d) for w in t)
    total, kinds = sum(count.values()), len(count)
    want = sorted((str(d), len(t), sum(count[w] > 0 for w in t), round(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in t), 6)) for d, t in texts)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == total and r.score <= 1e-9 for r in got)
    assert suffix_tree_lm.score(none(spark), crc_mod("doc_id", 7) != 2).collect() == []


def test_language_model_is_a_distribution(spark):
    """Probabilities of all next words after a context, and of an unknown one, sum to 1."""
    train = [(i, "the cat sat on the mat and the dog sat on the rug") for i in range(40)] + [(i + 40, f"the bird{i} flew") for i in range(10)]
    vocabulary = sorted({w for _, t in train for w in t.split()})
    probe = [(1000 + i, f"dog sat on the {w}") for i, w in enumerate([*vocabulary, "neverseen"])] + [(2000, "dog sat on the")]
    table = spark.createDataFrame(train + probe, "doc_id long, text string")
    got = {r.doc_id: r.score for r in suffix_tree_lm.score(table, F.col("doc_id") < 1000).collect()}
    # a text's score ends with its end token, whose probability differs by what precedes it: compare prefixes by words scored alone
    assert max(got[1000 + i] for i in range(len(vocabulary))) == max(got[1000 + vocabulary.index("rug")], got[1000 + vocabulary.index("mat")])
    assert got[1000 + vocabulary.index("rug")] > got[1000 + len(vocabulary)] + 1


def test_html(spark):
    menu = "<div><ul><li>Home page</li><li>All news</li><li>Contact us today</li></ul></div>"
    page = lambda body: f"<html><head><title>t</title></head><body>{menu}{body}</body></html>"
    rows = [
        (1, "http://h/1", page("<p>Unique &amp; first&nbsp;text of the page<br>goes on.</p><p>More.</p>"), "x"),
        (2, "http://h/2", page("<div>Second page has other text altogether</div><script>var a='<p>no</p>'</script>"), "x"),
        (3, "http://h/3", page("<h1>Third</h1><p>Words of the third page</p><div class='cookie-notice'>We use cookies</div>"), "x"),
        (4, "http://h/4", "<nav>menu</nav><article><header><h1>Title</h1>by me</header><p>Body <b>bold</b>  text<p>Next</p><aside>side</aside><div class='comments'>c</div></article><footer>f</footer>", "x"),
        (5, None, None, "x"), (6, "u", "", None), (6, "u", "", None), (7, "http://g/1", "plain text, no tags", None), (9, "http://k/1", "<main><p>crumbs</p><article>In the article</article></main>", None), (10, "http://k/2", "<main><p>In main</p></main><p>out</p>", None), (8, "http://g/2", "<form>in</form><p>kept<!-- gone --></p>", None),
    ]
    got = sorted((r.page_id, r.text) for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect())
    assert got == [
        (1, "Unique & first text of the page goes on.\nMore."), (2, "Second page has other text altogether"), (3, "Third\nWords of the third page"), (4, "Title\nBody bold text\nNext"),
        (5, ""), (6, ""), (6, ""), (7, "plain text, no tags"), (8, "kept"), (9, "In the article"), (10, "In main"),
    ]
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("block", [1 << 22, 60])
def test_html_repeated_runs_by_brute_force(spark, block):
    import random

    rng = random.Random(1)
    pages = [[" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(1, 5))] for _ in range(60)]
    pages += [pages[7], pages[7], pages[7]]  # equal pages count as one
    rows = [(i, f"http://h{i % 2}/{i}", "".join(f"<div>{b}</div>" for b in blocks)) for i, blocks in enumerate(pages)]
    n, least = html_extract.RUN, html_extract.PAGES
    seen = defaultdict(set)
    for i, blocks in enumerate(pages):
        tokens = " ".join(blocks).split()
        for j in range(len(tokens) - n + 1):
            seen[i % 2, tuple(tokens[j : j + n])].add(tuple(blocks))
    want = {}
    for i, blocks in enumerate(pages):
        tokens, kept, at = " ".join(blocks).split(), [], 0
        mark = [False] * len(tokens)
        for j in range(len(tokens) - n + 1):
            if len(seen[i % 2, tuple(tokens[j : j + n])]) >= least:
                mark[j : j + n] = [True] * n
        for b in blocks:
            size = len(b.split())
            kept += [b] if sum(mark[at : at + size]) < html_extract.COVERED * size else []
            at += size
        want[i] = "\n".join(kept)
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), block=block).collect()}
    assert got == want and "" in want.values() and len({*want.values()}) > 40


def labelled(spark, flag):
    """Rows where flag marks label 1, in two languages."""
    good = [(i, f"the house of the {['red', 'blue', 'green'][i % 3]} garden number{i % 17}" + (flag if i % 4 == 0 else ""), "en" if i % 2 else "de", i) for i in range(200)]
    return spark.createDataFrame(good, "doc_id long, text string, lang string, n_chars long"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200)] + [(3, None), (None, 1)], "doc_id long, label int")


@pytest.mark.parametrize("module", [quality_fm, toxicity_cnn])
def test_classifiers(spark, module):
    rows, labels = labelled(spark, " vile nonsense!!! ###")
    scored = module.score(rows, labels).join(labels.where("label is not null and doc_id is not null"), "doc_id").collect()
    assert sum((r.score >= 0.5) == (r.label == 1) for r in scored) >= 190
    odd = module.score(docs(spark), labels).collect()
    assert len(odd) == docs(spark).count() and all(0 <= r.score <= 1 for r in odd)
    assert module.score(none(spark), labels).collect() == []
    assert {r.score for r in module.score(docs(spark), labels.where("false")).collect()} == {0.5}


def test_language(spark):
    en, de = "the house and the garden of this old town with many trees", "das haus und der garten dieser alten stadt mit vielen bäumen"
    rows = spark.createDataFrame([(i, " ".join([en, de][i % 2].split()[i % 5 :]), ["en", "de"][i % 2]) for i in range(300)], "doc_id long, text string, lang string")
    got = language_crf.label_languages(rows, crc_mod("doc_id", 3) != 1).join(rows, "doc_id").collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    mixed = spark.createDataFrame([(1, en + " " + de, None), (2, None, None), (3, " 12 34 -- ", "en"), (4, "★ 12", None)], "doc_id long, text string, lang string")
    model_rows = rows.unionByName(mixed.withColumn("doc_id", F.col("doc_id") + 1000))
    odd = {r.doc_id: r for r in language_crf.label_languages(model_rows, F.col("doc_id") < 1000).where("doc_id > 1000").collect()}
    assert odd[1001].n_switches == 1 and [odd[1000 + i].lang_pred for i in (2, 3, 4)] == ["und"] * 3
    assert language_crf.label_languages(none(spark), crc_mod("doc_id", 3) != 1).collect() == []


def test_mixing_meets_targets(spark):
    rows = spark.createDataFrame([(i, ("alpha beta gamma " if i % 4 else "eins zwei drei ") * (1 + i % 7), "x") for i in range(400)] + [(900, None, None), (900, None, None)], "doc_id long, text string, rate string")
    labels = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(0, 400, 3)] + [(1, None)], "doc_id long, domain string")
    got = mixing.mix(rows, labels, {"a": 1.0, "b": 1.0}).collect()
    total = {k: sum(r.n_tokens * r.rate * (r.posterior if r.domain == k else 1 - r.posterior) for r in got) for k in "ab"}
    assert len(got) == 402 and all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in got)
    assert abs(total["a"] / (total["a"] + total["b"]) - 0.5) < 0.01
    assert len(mixing.mix(docs(spark), labels.where("false"), {"a": 1.0}).collect()) == docs(spark).count()
    assert mixing.mix(none(spark), labels, {"a": 1.0}).collect() == []


@pytest.mark.parametrize("block", [2048, 2])
def test_near_dedup_heads_unlike_a_pair(spark, monkeypatch, block):
    """In every bucket that two near copies share, the least set is a short text unlike both."""
    import numpy as np

    monkeypatch.setattr(near_dedup, "CROSS", block)
    first = [f"w{i}" for i in range(400)]
    second = [*first[:200], "changed", *first[201:]]

    def signed(texts):
        raw = [t.encode() for t in texts]
        elements, counts = near_dedup.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 2)
        return near_dedup.super_minhash(elements, counts)

    a, b = signed([" ".join(first), " ".join(second)])
    alone = signed([f"{x} {y}" for x, y in zip(first, first[1:], strict=False)])
    heads = []
    for low in range(0, near_dedup.SLOTS, near_dedup.ROWS):
        slots = slice(low, low + near_dedup.ROWS)
        if (a[slots] == b[slots]).all():
            pairs = sorted({int((alone[:, s] == a[s]).argmax()) for s in range(low, low + near_dedup.ROWS)})
            head = next(t for k in range(100) if (signed([t := " ".join(f"{first[p]} {first[p + 1]} z{low}k{k}" for p in pairs)])[0][slots] == a[slots]).all())
            heads.append(head)
    assert len(heads) > 5
    rows = spark.createDataFrame(list(enumerate([*heads, " ".join(first), " ".join(second)])), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(rows, shingle=2, percent=80).collect()}
    assert got == {i: min(i, len(heads)) for i in range(len(heads) + 2)}


@pytest.mark.parametrize(
    "page",
    [
        "<head><title>t</title><style>s{}</style><body><article><p>The text</p></article>",
        "<html><head><meta charset=x><title>t</title><article><p>The text</p></article>",
        "<head class='notice'><title>t</title><p>The text</p>",
        "<svg viewBox='0 0 1 1' /><p>The text</p>",
        "<article><math/><p>The text</p></article><svg><title>no</title></svg>",
        "<p><svg-icon name=x></svg-icon>The text</p>",
        "<article><select><p>The text</p></article>",
        "<iframe src=x><p>The<textarea> text</p>",
        "<p>The<script>var a = '<p>no</p>'</script > text</p>",
        "<![CDATA[ ><p>The text</p>",
        "<![CDATA[ <p>no</p> ]]><p>The text</p>",
        "<p title=it's>The text",
        "<p title=\"never ends>The text</p><p title='>",
        "<p title=\"a > b\" 'odd' x='>'>The text</p>",
        "<header><h2>no</h2></header><article><div class='post-header'>The text</div></article>",
        "<div class='content has-sidebar no-ads'>The text</div><div class='sidebar-wrapper'>no</div>",
        "<p class='search-results'>The text</p><div class='comments-area'>no</div><div id=siteFooter>no</div>",
        "<!-->The text<!-- no --><? no ><!-- never ends <p>no",
        "<p>The text</p><div never ends",
    ],
)
def test_html_raw_elements_take_no_more_than_their_own(page):
    assert [t for t, _, d in html_extract.blocks(page) if not d] == ["The text"]


@pytest.mark.parametrize("block", [1 << 22, 100])
def test_html_runs_count_over_the_whole_host(spark, block):
    own = lambda i: " ".join(f"own{i}x{j}" for j in range(9))
    rare, twice = "this notice stands on just three of the pages", "these words stand on only two of the pages"
    rows = [(i, f"http://h/{i}", f"<div>{own(i)}</div>" + f"<div>{rare}</div>" * (i in (3, 17, 31)) + f"<div>{twice}</div>" * (i in (5, 22))) for i in range(40)]
    rows.append((99, "http://other/1", f"<div>{twice}</div>"))
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), block=block).collect()}
    assert got == {i: own(i) + ("\n" + twice) * (i in (5, 22)) for i in range(40)} | {99: twice}


@pytest.mark.parametrize("block", [1 << 22, 100])
def test_html_articles_keep_what_they_share(spark, block):
    """Sentences, notices and whole stories that articles of a host share are the articles' own, at any length."""
    own = lambda i: " ".join(f"own{i}x{j}" for j in range(12))
    said, story, notice = "There is no doubt about it at all, she said.", " ".join(f"story{j}" for j in range(30)), " ".join(f"long{j}" for j in range(100))
    page = lambda *blocks: "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"
    rows = [(i, f"http://h/{i}", page(own(i), said, own(i + 100))) for i in range(3)]
    rows += [(20 + i, f"http://h/m{i}", page(story, "the end of it")) for i in range(5)]  # mirrors
    rows += [(30 + i, f"http://h/n{i}", page(f"near{i} " + own(50), own(51))) for i in range(5)]  # mirrors but for a word
    rows += [(40 + i, f"http://h/l{i}", f"<aside>{own(1)}</aside>" + page(own(60 + i), notice)) for i in range(4)]
    rows += [(50 + i, f"http://h/w{i}", f"<div>{said} We use cookies here.</div><article><p>{own(80 + i)}</p></article>") for i in range(3)]
    rows += [(60, "http://h/p", f"<p>{said} We use cookies here.</p><p>{own(99)}</p>"), (61, "http://g/p", f"<p>{said} We use cookies here.</p>")]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), block=block).collect()}
    want = {i: f"{own(i)}\n{said}\n{own(i + 100)}" for i in range(3)} | {20 + i: story + "\nthe end of it" for i in range(5)} | {30 + i: f"near{i} {own(50)}\n{own(51)}" for i in range(5)}
    want |= {40 + i: f"{own(60 + i)}\n{notice}" for i in range(4)} | {50 + i: own(80 + i) for i in range(3)}
    # a page without an article is held against what stands outside the articles of its host
    assert got == want | {60: own(99), 61: f"{said} We use cookies here."}


def tree_scores(train, probes, longest):
    """Scores by a tree that tests every context seen often enough, whatever its prefix and suffix, and its states."""
    count, after = Counter(), defaultdict(Counter)

    def contexts(t):
        symbols = ["START", *t.split(), "END"]
        for i in range(1, len(symbols)):
            yield symbols[i], [tuple(symbols[i - d : i]) for d in range(1, longest + 1) if i >= d]

    for t in train:
        for x, found in contexts(t):
            count[x] += 1
            for c in found:
                after[c][x] += 1
    total, kinds = sum(count.values()), len(count)
    kept = set()

    def probability(c, x):
        if not c:
            return (count[x] + 1) / (total + kinds + 1)
        p = probability(c[1:], x)
        return (after[c][x] + len(after[c]) * p) / (after[c].total() + len(after[c])) if c in kept else p

    for depth in range(1, longest + 1):
        for c in [c for c in after if len(c) == depth and after[c].total() >= suffix_tree_lm.SEEN]:
            n, t = after[c].total(), len(after[c])
            gain = sum(k * math.log((k - 1 + t * p) / ((n - 1 + t) * p)) for x, k in after[c].items() for p in [probability(c[1:], x)])
            if gain > suffix_tree_lm.GAIN:
                kept.add(c)
    return [sum(math.log10(probability(found[-1], x)) for x, found in contexts(t)) for t in probes], kept


@pytest.mark.parametrize("longest, block", [(2, 1 << 21), (3, 3000), (6, 1 << 21), (1, 500)])
def test_language_model_against_a_brute_force_tree(spark, longest, block):
    import random

    rng = random.Random(5)
    train = [" ".join(f"v{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(30)) for _ in range(40)]
    # q has many single successors, so its own state fails; what follows "q z" is plain
    train += [f"q u{i} a{i}" for i in range(150)] + ["q z hit"] * 12 + [f"r{i} z other{i}" for i in range(150)]
    train += [f"k{j} l m n o{j}" for j in range(4)] * 6  # only four words before tell what follows
    if longest == 1:  # contexts with more than a bucket's share of all tokens
        train += [f"s{i % 40}" for i in range(19000)]
    probe = ["q z hit", "q z other1", "s1", "s1 s2", "q u1", "v1 v2 v1 v1 v3", "z hit", "", "k2 l m n o2", "k2 l m n o3"]
    texts = [(i, t) for i, t in enumerate(train)] + [(10**6 + i, t) for i, t in enumerate(probe)]
    got = {r.doc_id: r.score for r in suffix_tree_lm.score(spark.createDataFrame(texts, "doc_id long, text string"), F.col("doc_id") < 10**6, depth=longest, block=block).collect()}
    wanted, kept = tree_scores(train, [t for _, t in texts], longest)
    assert ("q",) not in kept and (("q", "z") in kept) == (longest > 1) and (("k2", "l", "m", "n") in kept) == (longest > 3)
    for (i, t), want in zip(texts, wanted, strict=True):
        assert abs(got[i] - want) < 1e-4 * max(1, abs(want)), (t, got[i], want)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_language_model_of_hot_contexts_however_they_are_dealt(spark, longest):
    """Contexts in a large share of all tokens, near the test's limit: scores don't depend on the buckets."""
    import random

    rng = random.Random(11)
    train = [" ".join(f"the w{min(int(rng.paretovariate(0.6)), 300)}" for _ in range(rng.randrange(1, 4))) for _ in range(1500)]
    train += [f"of the {rng.choice(['a', 'b', 'c', f'x{i}'])}" for i in range(700)]
    probes = ["the w1 the w2", "of the a", "of the x3 the", "the", "", "the the of", *train[:40]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(train)] + [(10**6 + i, t) for i, t in enumerate(probes)], "doc_id long, text string")
    before, wanted = spark.conf.get("spark.sql.shuffle.partitions"), tree_scores(train, probes, longest)[0]
    try:
        for n in ("1", "4", "64", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {r.doc_id: r.score for r in suffix_tree_lm.score(rows, F.col("doc_id") < 10**6, depth=longest).where("train = 0").collect()}
            assert [got[10**6 + i] for i in range(len(probes))] == pytest.approx(wanted, rel=1e-4), n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_html_takes_time_in_proportion_to_the_page():
    import time

    for unit in ("<a x=\"", "<p title='", "<b>", "<![CDATA[ x", "<i></b>", "< ", "<script>", "<div><p>"):
        began = time.perf_counter()
        html_extract.blocks(unit * (2_000_000 // len(unit)))
        assert time.perf_counter() - began < 20, unit


def test_html_text_with_signs_below_and_above():
    assert [t for t, _, _ in html_extract.blocks("<p>1 < 2 && 3 > 2 &amp; a<5 I <3 you</p>")] == ["1 < 2 && 3 > 2 & a<5 I <3 you"]


def test_previous_factors_by_brute_force():
    import random

    import numpy as np

    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(1, 40)
        values = [rng.randrange(9) for _ in range(n)]
        before, after = suffix_dedup.smaller_positions(np.array(values))
        assert before.tolist() == [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(n)]
        assert after.tolist() == [min((j for j in range(i + 1, n) if values[j] < values[i]), default=n) for i in range(n)]
        rank = [rng.randrange(4) for _ in range(n)]
        want = [suffix_dedup.LENGTH * any(r == rank[i] and v < values[i] for r, v in zip(rank, values, strict=True)) for i in range(n)]
        assert suffix_dedup.previous_factors(np.array(rank), np.array(values)).tolist() == want


def test_suffix_classes_of_far_buckets_stay_apart():
    import numpy as np

    rows = np.zeros((4, suffix_dedup.WIDTH + 6), np.uint8)
    rows[3] = 1
    bucket = np.array([5, 5 + (1 << 20), 5 + (1 << 31), 5 + (1 << 31)], np.uint64)
    kind, one = suffix_dedup._distinct(bucket << np.uint64(32), rows)
    assert len(one) == 4 and (np.diff(bucket[one].astype(np.int64)) >= 0).all() and sorted(kind.tolist()) == [0, 1, 2, 3]


def test_near_dedup_of_an_id_with_unlike_texts(spark):
    """Either text may count, but the same whatever the order of the rows, and not both."""
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, one), (1, two), (1, None), (2, one + " x"), (3, two + " y")]
    seen = []
    for order in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        table = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        seen.append(sorted(map(tuple, near_dedup.near_groups(table, shingle=2, percent=80).select("doc_id", "component_id", "n_shingles").collect())))
    assert seen[0] == seen[1] == seen[2]
    assert {d: c for d, c, _ in seen[0]} in ({1: 1, 2: 1, 3: 3}, {1: 1, 2: 2, 3: 1}) and len(seen[0]) == 5


def test_decontaminate_long_text_full_of_one_window(spark):
    """20,000 words that repeat one window of 50 items, and a text that holds it once."""
    window = [f"w{i}" for i in range(13)]
    items = [(i, " ".join([*window, f"own{i}"])) for i in range(50)] + [(99, "short item"), (98, "w0 w1")]
    texts = [(1, " ".join(window * 1540)), (2, " ".join(["x"] * 100 + window)), (3, " ".join(window[:12])), (None, " ".join(window))]
    got = {r.doc_id: r for r in decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [(got[d].n_words, got[d].n_hit, got[d].n_items) for d in (1, 2, 3, None)] == [(20_020, 20_020, 51), (113, 13, 51), (12, 2, 1), (13, 13, 51)]
    all_ids = ",".join(sorted([*map(str, range(50)), "98"]))
    assert got[1].items_sha256 == hashlib.sha256(all_ids.encode()).hexdigest()


def test_near_dedup_pair_among_thousands_of_quotes(spark):
    """Two near copies, and 12,000 shorter texts of lower ids that quote 30 shingles of the first."""
    first = [f"w{i}" for i in range(101)]
    second = [f"changed{i}" if i in (9, 29, 49, 69, 89) else w for i, w in enumerate(first)]
    texts = [" ".join([*first[i % 70 : i % 70 + 31], *(f"q{i}x{j}" for j in range(10))]) for i in range(12_000)]
    rows = spark.createDataFrame(list(enumerate([*texts, " ".join(first), " ".join(second)])), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(rows, shingle=2, percent=80).where("doc_id >= 12000 or not kept").collect()}
    assert got == {12_000: 12_000, 12_001: 12_000}


def test_near_dedup_finds_all_links_of_loosely_alike_texts(spark):
    """Families of texts that are 0.5 to 0.95 alike, against brute force."""
    import random

    import numpy as np

    rng = random.Random(8)
    texts = []
    for base in range(25):
        words = [f"b{base}w{i}" for i in range(80)]
        for _ in range(60):
            own = list(words)
            for i in rng.sample(range(80), rng.randrange(1, 13)):
                own[i] = f"x{rng.randrange(60)}"
            texts.append(" ".join(own))
        texts += [texts[-1], texts[-1] + " tail"]
    rng.shuffle(texts)
    sets = [{*zip(t.split(), t.split()[1:], strict=False)} for t in texts]
    code = {s: i for i, s in enumerate({x for s in sets for x in s})}
    member = np.zeros((len(sets), len(code)), np.float32)
    for i, s in enumerate(sets):
        member[i, [code[x] for x in s]] = 1
    shared, size = member @ member.T, member.sum(axis=1)
    label = np.arange(len(sets))
    for a, b in zip(*np.nonzero(100 * shared >= 80 * (size[:, None] + size - shared)), strict=True):
        if label[a] != label[b]:
            label[label == max(label[a], label[b])] = min(label[a], label[b])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(rows, shingle=2, percent=80).collect()}
    assert got == dict(enumerate(label.tolist())) and 100 < len({*got.values()}) < len(texts) - 300


def test_hot_keys_join_like_others(spark, monkeypatch):
    from tideline.llm import _links

    monkeypatch.setattr(_links, "HOT", 3)
    rows = spark.createDataFrame([(k, i) for k in range(6) for i in range(k)], "k long, i long")
    one = spark.createDataFrame([(k, k, f"v{k}") for k in range(1, 5)], "k long, n long, v string")
    for bound in (1 << 20, 0):  # hot keys that can be broadcast, and ones that are too many
        monkeypatch.setattr(_links, "fits_broadcast", lambda n, width, bound=bound: n * width <= bound)
        assert sorted(map(tuple, _links.join_hot(rows, one, "k", "n").collect())) == sorted((k, i, f"v{k}") for k in range(1, 5) for i in range(k))
    links = spark.createDataFrame([(0, i) for i in range(1, 20)] + [(30 + i, 31 + i) for i in range(9)] + [(50, 5), (7, 7)], "u long, v long")
    assert {r.node: r.component for r in _links.components(links).collect()} == {i: 0 for i in [*range(20), 50]} | {i: 30 for i in range(30, 40)}
