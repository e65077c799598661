"""Edge cases of every operator: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from strandline.llm import bpe, chat, common, compression_quality, html_extract, mixing, ngram_join, quality_rules, queries, toxicity, vafile
from strandline.llm.common import WORD, ascii_lower

SCHEMA = "doc_id long, text string, source string"


def docs(spark, texts, extra=""):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA)
    for c in extra.split():
        df = df.withColumn(c, F.lit("clash"))
    return df


# ---------------------------------------------------------------- 1
def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path, pattern = queries.vocabulary()
    ranks = bpe.load_ranks(path)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(2)
    letters = ["a", "the", "ing", " ", "\n", "  ", "é", "日本", "🙂", "'s", "12", "\x1c", "\x85", "\xa0", "и"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(300)]
    texts += [None, "", "ab" * 20000, " " * 5000, "<|endoftext|>", "the", "the"]
    out = bpe.decode(bpe.encode(docs(spark, texts, "ids decoded"), path, pattern), path, pattern).collect()
    assert len(out) == len(texts)
    for r in out:
        t = texts[r.doc_id] or ""
        assert memoryview(bytes(r.ids)).cast("I").tolist() == own.encode_ordinary(t)
        assert bytes(r.decoded).decode() == t
    both = bpe.encode_decode(docs(spark, texts, "ids decoded"), path, pattern)
    assert sorted(map(str, both.collect())) == sorted(map(str, out))
    assert bpe.encode(docs(spark, []), path, pattern).count() == 0


# ---------------------------------------------------------------- 2
def brute_repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})


def test_quality_counts(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 14))) for _ in range(60)]
    texts += [None, "", "   ", "\n\n", "a\nb\na \na\n", "x" * 9, "the of #*$ a…\n- b...", "w " * 140_000]
    out = {r.doc_id: r for r in quality_rules.judge(docs(spark, texts, "n_words kept")).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts[:-1]):
        words = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = out[i]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == brute_repeats(words)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
    assert out[len(texts) - 1].n_repeat_words == 140_000 and not out[len(texts) - 1].kept
    assert quality_rules.judge(docs(spark, [])).count() == 0


@pytest.mark.parametrize("bits,places", [(1, 17), (3, 17), (2, 3), (64, 3)])
def test_windows_of_equal_hash_are_compared(spark, monkeypatch, bits, places):
    """Hashes of few bits collide all the time; texts past 2^places - 1 words take the other sort."""
    monkeypatch.setattr(quality_rules, "HASH_BITS", bits)
    monkeypatch.setattr(quality_rules, "PLACE_BITS", places)
    rnd = random.Random(bits)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 30))) for _ in range(80)]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.measure(docs(spark, texts)).collect()}
    assert got == {i: brute_repeats(t.split()) for i, t in enumerate(texts)}


def test_rules_keep_rows_with_all_their_columns(spark):
    good = "the word of this and that is in a text for all to read " * 3 + " ".join(f"word{i}" for i in range(60))
    df = docs(spark, [good, "too short", None, "", good], "n_words kept __text __words").withColumn("a.b", F.lit(1))
    got = quality_rules.keep(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [0, 4]
    assert {r.n_words for r in got.collect()} == {"clash"}
    assert quality_rules.keep(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 3
PAGE = """<html><head><title>T</title></head><body><header>H</header><nav><a href=1>m</a><a href=2>n</a></nav><div class="cookie-notice">ok?</div>
<article><h1>Head &amp; more</h1><p>One  two<br>three<p>Four <a href=x>five</a> six.<form>f</form><script>var a="<p>no</p>"</script></article>
<div id="comments"><p>bad words</p></div><aside>side</aside><footer>foot</footer></body></html>"""


def test_html(spark):
    assert html_extract.extract_text(PAGE) == "Head & more\n\nOne two three\n\nFour five six."
    prose = "<div><h2>Big</h2>" + "<p>" + "word " * 60 + "</p>" * 2 + "</div>"
    links = "<div class=x>" + "<a href=1>link</a> " * 30 + "</div>"
    got = html_extract.extract_text(f"<body>{links}<div>{prose}</div>{links}</body>")
    assert got.startswith("Big\n\nword") and "link" not in got
    rows = [(1, PAGE, "x"), (1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (4, "<" * 500, "x"), (5, "<div>" * 3000 + "deep", "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = [(r.page_id, r.text) for r in html_extract.extract(df).collect()]
    assert len(out) == 6 and out[0] == out[1] and out[2:4] == [(2, ""), (3, "")] and out[5] == (5, "deep")


def test_html_keeps_articles_in_marked_wrappers():
    prose = "<h2 class='section-header'>Head</h2>" + "<p>" + "word " * 80 + "</p>" + "<p title='the hidden gem' data-id='nav'>" + "more " * 80 + "</p>"
    want = "Head\n\n" + " ".join(["word"] * 80) + "\n\n" + " ".join(["more"] * 80)
    side = "<div class='sidebar'><p>side text</p></div><div hidden>unseen</div><p aria-hidden=true>unseen</p>"
    for wrap in ("layout has-sidebar", "content no-sidebar", "page-wrapper with-header", "header", "page side"):
        assert html_extract.extract_text(f"<body>{side}<div class='{wrap}'>{prose}</div>{side}</body>") == want, wrap
        assert html_extract.extract_text(f"<body><div class='{wrap}'>{side}<div>{prose}</div></div></body>") == want, wrap
    assert html_extract.extract_text(f"<body><div class='widget'><article>{prose}</article></div><p>{'other ' * 300}</p></body>").startswith("Head\n\nword")
    assert html_extract.extract_text(f"<body><article><p>{'word ' * 20}</p></article><div id='comments'><p>{'bad ' * 300}</p></div></body>") == " ".join(["word"] * 20)


def test_html_tags_end_where_html_ends_them():
    text = html_extract.extract_text
    assert text("<article><p data-x=it's>Hello world</p><p>More text don't</p></article>") == "Hello world\n\nMore text don't"
    assert text("<p title=O'Neil>Own</p>") == "Own" and text('<p title="a > b">x</p>') == "x" and text("<p a='>'b=\">\">x</p>") == "x"
    assert text("<p a=\"b>one</p><p>two</p>") == "one\n\ntwo" and text("a < b & c <3 &lt; d") == "a < b & c <3 < d"
    assert text("x<!-->y<!---->z<!-- <p> -->w<!-- open") == "xyzw" and text("<p>one <b") == "one <b"
    assert text("<p>a<p>b<div>c</p>d</div>") == "a\n\nb\n\nc\n\nd" and text("<p class='side-effects'>kept</p><p>too</p>") == "kept\n\ntoo"
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == "a\n\nb\n\nc\n\nd\n\ne"


def test_html_is_linear_in_the_page():
    import time

    bad = ['<a "', '<a b="', '<a b=">" ', "<", "<div>", "<td>", "<!--", "</p>", "<li>", "<div>x", "<a b='x' c=\"'\">"]
    for part in bad + ["<p><button>" + "<span>" * 9999 + "<div></div>"]:
        began = time.time()
        html_extract.extract_text(part * (400_000 // len(part)))
        assert time.time() - began < 4, part[:20]


def brute_density(node):
    """Characters, tags, those of links, density and sum of a node, each by walking its subtree."""
    import math

    def kids(n):
        return [x for x in n.items if not isinstance(x, str) and not x.noise]

    def under(n):
        return [y for x in kids(n) for y in [x, *under(x)]]

    def chars(n):
        return sum(len("".join(x.split())) for m in [n, *under(n)] for x in m.items if isinstance(x, str))

    def links(n):
        """The outermost links below n."""
        return [y for x in kids(n) for y in ([x] if x.tag == "a" else links(x))]

    def tags(nodes):
        return sum(x.tag not in html_extract.INLINE for x in nodes)

    root = node
    while root.parent is not None:
        root = root.parent

    def density(n):
        c, t = chars(n), max(1, tags(under(n)))
        lc, lt = sum(map(chars, links(n))), max(1, sum(tags([x, *under(x)]) for x in links(n)))
        if not c:
            return 0.0
        ratio = sum(map(chars, links(root))) / max(1, chars(root))
        base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
        return c / t * math.log(max(1.0, c / max(1, lc) * t / lt) + 1) / base

    return chars(node), tags(under(node)), density(node), sum(density(x) for x in kids(node) if x.tag not in html_extract.INLINE)


def test_html_density_against_brute_force():
    rnd = random.Random(6)
    tags = ["div", "p", "a", "b", "ul", "li", "nav", "section", "h2", "span", "article", "form"]
    for _ in range(60):
        page = "".join(rnd.choice([f"<{rnd.choice(tags)}>", f"</{rnd.choice(tags)}>", "word " * rnd.randint(1, 9), "&amp;", "<br>"]) for _ in range(40))
        root = html_extract.parse(f"<body>{page}</body>")
        for node in html_extract.measure(root):
            chars, n_tags, density, total = brute_density(node)
            assert (node.chars, node.tags) == (chars, n_tags)
            assert node.density == pytest.approx(density) and node.total == pytest.approx(total)
        body = next(x for x in html_extract.measure(html_extract.parse(f"<body>{page}</body>")) if x.tag in ("body", "#root"))
        if body.chars:
            best, least, parts = html_extract.parts_of(body)
            inside = [x for x in html_extract._below(body) if x.tag not in html_extract.INLINE]
            assert max(best.total, best.density * (best.total == 0)) == max(max(x.total, x.density * (x.total == 0)) for x in inside)
            path, up = [best.density], best
            while up is not body:
                up = up.parent
                path.append(up.density)
            assert least == min(path) and parts


def test_html_density_finds_the_article_without_its_tag(spark):
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in pages:
        assert html_extract.extract_text(re.sub(r"<(/?)article\b", r"<\1div", r.html)) == html_extract.extract_text(r.html)
    parts = "".join(f"<section><h2>Part {i}</h2>" + f"<p>{'word ' * 50}</p>" * 9 + "</section>" for i in range(3))
    page = f"<body><div class=m><a href=1>one</a><a href=2>two</a></div><h1>Title</h1><div>{parts}</div><div>short note</div></body>"
    got = html_extract.extract_text(page).split("\n\n")
    assert [x for x in got if x.startswith("Part")] == ["Part 0", "Part 1", "Part 2"] and len(got) == 30


def test_html_of_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(df).count() == 0
    assert html_extract.extract(df).columns == ["page_id", "url", "html", "text"]


# ---------------------------------------------------------------- 4
def brute_components(rows, size, num, den):
    sets = []
    for _, t in rows:
        w = WORD.findall(ascii_lower(t or ""))
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    links = [set() for _ in rows]
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            comp[root(i)] = root(j)
            if sets[i] != sets[j]:
                links[i].add(frozenset(sets[j]))
                links[j].add(frozenset(sets[i]))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least[root(i)], len(n)) for i, ((d, _), s, n) in enumerate(zip(rows, sets, links))]


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 80, 100), (3, 50, 100)])
def test_jaccard_components(spark, monkeypatch, size, num, den):
    rnd = random.Random(size * num)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)  # families of several blocks
    monkeypatch.setattr(common, "HOT_SHARE", 40)  # classes of some copies count as hot, others don't
    texts = []
    for n in (1, 2, 3, 4, 5, 6, 9, 12, 14, 20, 30, 45, 80, 200):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(n)]
        for _ in range(9):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, n // 18))):
                copy[rnd.randrange(len(copy))] = f"v{rnd.randint(0, 9)}"
            texts.append(" ".join(copy))
    texts += [None, "", "  ", texts[5].upper(), "of the and"] * 2
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(1000, texts[0])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, component_id string").repartition(3)
    got = sorted(tuple(r) for r in ngram_join.components_of(df, size, (num, den)).collect())
    assert got == sorted(brute_components(rows, size, num, den))


def test_jaccard_keeps_rows_without_id(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (None, "e f g"), (None, None)], "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in ngram_join.components_of(df).collect())))
    assert got == sorted(map(str, [(None, 2, 3, 0), (None, 2, 3, 0), (3, 2, 3, 0), (None, 1, None, 0), (None, 0, None, 0)]))


@pytest.mark.parametrize("hot", [100, 10**6])
def test_components_of_long_chains_and_hubs(spark, monkeypatch, hot):
    from strandline.llm import components

    monkeypatch.setattr(components, "HOT_ROWS", hot)  # hubs take the other way, or not
    chain = [(i, i + 1) for i in range(700)]
    rnd = random.Random(1)
    mixed = list(range(1000, 1400))
    rnd.shuffle(mixed)
    edges = chain + list(zip(mixed, mixed[1:])) + [(5000, 2000 + i) for i in range(200)] + [(3000, 3001 + i) for i in range(200)] + [(7, 7), (9, 8), (None, 4)]
    got = {r.node: r.comp for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(701)} == {0} and {got[i] for i in mixed} == {1000}
    assert {got[i] for i in [5000, *range(2000, 2200)]} == {2000} and {got[i] for i in range(3000, 3201)} == {3000}
    assert len(got) == 701 + 400 + 201 + 201
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_of_very_long_texts(spark):
    rnd = random.Random(3)
    long = [f"w{rnd.randint(0, 10**6)}" for _ in range(120_000)]
    near = list(long)
    for _ in range(300):
        near[rnd.randrange(len(near))] = "other"
    rows = [(5, " ".join(long)), (3, " ".join(near)), (9, " ".join(long[:60_000]))]
    got = sorted(tuple(r)[0::2] for r in ngram_join.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3), (5, 3), (9, 9)]


def test_jaccard_empty(spark):
    assert ngram_join.components_of(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 5 and 7
def labelled(n, good, bad, seed):
    rnd = random.Random(seed)
    say = lambda words: " ".join(rnd.choice(words) for _ in range(60))
    return [(say(bad if i % 2 else good), i % 2) for i in range(n)]


def test_toxicity(spark):
    good = [f"clean{i}" for i in range(200)]
    sample = labelled(400, good, good, 1)
    sample = [(t + (" you are a worthless moron " if y else ""), y) for t, y in sample]
    model = toxicity.fit(sample)
    assert {"worthless", "moron"} <= set(model.terms)
    texts = ["clean1 worthless clean2 moron", "clean1 clean2", None, "", "clean3 worthles clean4 w0rthless", "he said «worthless» in a quote"]
    s = {r.doc_id: r.score for r in toxicity.score(docs(spark, texts, "score"), model).collect()}
    assert s[0] > 0.7 > s[1] and s[2] == s[3] == s[1] and s[4] > s[1] and all(0 <= v <= 1 for v in s.values())
    assert toxicity.fit([]).terms == ()
    match = toxicity.Matcher(model)
    assert match["WORTHLESS!"] == (1, "worthless") and match["worhtless"][0] == 2 and match["clean7"] == 0


def test_levenshtein_automaton():
    trie = toxicity.Trie(("moron", "clown"))
    for word, hit in (("moron", True), ("morn", True), ("moroon", True), ("mroon", True), ("mozon", True), ("mxxon", False), ("clo", False)):
        assert (trie.within(word, 1) is not None) == hit, word


def test_short_terms_and_stem_families_are_found_misspelt():
    good = [f"clean{i}" for i in range(200)] + ["mould"]
    bad = ("scum", "idiot", "idiots", "idiotic", "idiocy", "mold")
    sample = [(t + (f" {bad[i // 2 % 6]} " if y else " mould "), y) for i, (t, y) in enumerate(labelled(600, good, good, 5))]
    model = toxicity.fit(sample)
    assert "idio" in model.stems and "scum" in model.terms
    match = toxicity.Matcher(model)
    assert match["scumm"] == match["sucm"] == match["scu"] == (2, "scum") and match["idoit"] == (2, "idiot")
    assert "mold" in model.terms and match["mould"] == 0 and match["clean7"] == 0


def test_every_single_edit_is_found():
    for term in ("stupid", "pathetic", "moron", "worthless"):
        match, trie = toxicity.Matcher(toxicity.ToxicModel((), (), (term,))), toxicity.Trie((term,))
        n = len(term)
        edits = {term[:i] + c + term[i + d :] for i in range(n + 1) for c in ("x", "e", "") for d in (0, 1)}
        edits |= {term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(n - 1)}
        edits |= {term[:i] + "xx" + term[i + 2 :] for i in range(n)}
        for word in edits:
            assert (match[word] != 0) == (trie.within(word, 1) is not None), word
    assert toxicity.Matcher(toxicity.ToxicModel((), (), ("stupid",)))["stpuid"] == (2, "stupid")


def test_compression(spark):
    sample = labelled(300, [f"plain{i}" for i in range(80)], [f"$$${i}!!" for i in range(80)], 2)
    model = compression_quality.fit([(t, 1 - y) for t, y in sample])
    held = labelled(60, [f"plain{i}" for i in range(80)], [f"$$${i}!!" for i in range(80)], 3)
    texts = [t for t, _ in held] + [None, "", "x" * 300_000]
    s = {r.doc_id: r.score for r in compression_quality.score(docs(spark, texts, "score"), model).collect()}
    assert sum((s[i] >= 0.5) == (y == 0) for i, (_, y) in enumerate(held)) >= 57
    assert s[60] == s[61] and 0 <= s[62] <= 1
    assert compression_quality.fit([]).good == b""


def test_dictionaries_learn_from_whole_texts(monkeypatch):
    seen = []
    monkeypatch.setattr(compression_quality, "_dictionary", lambda samples, size: seen.append(samples) or b"")
    texts = [("plain " * 50, 1), ("bad " * 50, 0), ("x" * 20_000 + "late", 1), ("y" * 8192 + "late", 0)]
    compression_quality.fit([r for r in texts for _ in range(2)])
    assert [b"".join(s) for s in seen] == [b"".join(t.encode() for t, y in texts if y == k) for k in (1, 0)]
    assert max(len(x) for s in seen for x in s) <= 8192


def test_toxicity_by_brute_force(spark):
    """Terms, windows, features and score of a text, each taken from its definition."""
    import math

    good = [f"clean{i}" for i in range(100)]
    sample = [(t + (f" you {('moron', 'scum', 'worthless')[i // 2 % 3]} {'now ' * 3}" if y else " he said « moron » once"), y) for i, (t, y) in enumerate(labelled(300, good, good, 4))]
    model = toxicity.fit(sample)
    match = toxicity.Matcher(model)
    texts = ["clean1 moron you scum clean2", "a morron here", "« moron » he said", "", None, "moron " * 20_000, "Idiot? MORON! moron;"]
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, texts, "score other"), model).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split()
        exact, near, mass = set(), set(), 0.0
        for k, w in enumerate(words):
            bare = toxicity.bare(w)
            hit = 1 if bare in model.terms else 2 if len(bare) > 2 and any(osa(bare, x) <= 1 for x in model.fuzzy) else 0
            if hit:
                (exact if hit == 1 else near).add(bare if hit == 1 else min(model.fuzzy, key=lambda x: osa(bare, x)))
                pull = sum(dict(model.context).get(x, 0) for x in toxicity.window(words, k))
                mass += math.exp(max(-1.5, min(1.5, pull)))
        n = len(exact), mass, len(near), 50 * sum(match[w] != 0 for w in words) / max(1, len(words))
        z = sum(min(a, b) * w for a, b, w in zip(n, toxicity.MOST, model.weights)) + model.weights[-1]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))
    assert toxicity.score(docs(spark, []), model).count() == 0
    assert toxicity.score(docs(spark, ["a"], "score other"), model).columns == ["doc_id", "text", "source", "other", "score"]


def test_context_is_learned():
    """The same word, quoted by clean texts and meant by toxic ones."""
    good = [f"clean{i}" for i in range(100)] + "shut up you now he said the word yesterday".split() * 3
    rnd = random.Random(8)
    around = lambda word, near: " " + " ".join([*rnd.sample(good[:100], 3), *rnd.sample(near, 2), word, *rnd.sample(near, 1), *rnd.sample(good[:100], 3)])
    sample = [(t + (around("moron", ["shut", "up", "you", "now"]) if y else around("«moron»", ["he", "said", "the", "word"])), y) for t, y in labelled(400, good, good, 7)]
    model = toxicity.fit(sample)
    assert "moron" in model.terms
    weight = dict(model.context)
    assert weight["shut"] > 0.5 > -0.5 > weight["said"] and weight[toxicity.QUOTED] < -0.5 and abs(weight.get("clean1", 0)) < 0.5
    match = toxicity.Matcher(model)
    assert toxicity.score_text("clean1 clean2 you moron shut up", model, match) > toxicity.score_text("clean1 he said the word « moron » here", model, match)
    assert toxicity.quoted("moron", "«") and toxicity.quoted("moron».", "x") and not toxicity.quoted("moron", "")


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_levenshtein_automaton_against_distances():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6)))
    for i in range(200):
        terms = tuple({word() for _ in range(20)})
        trie, q = toxicity.Trie(terms), word() if i else ""
        for most in (0, 1, 2):
            assert sorted(trie.all_within(q, most)) == sorted(t for t in terms if osa(t, q) <= most), (q, most)


def test_compression_by_brute_force(spark):
    """Sizes of whole texts by their windows, from compressors of the test's own."""
    import math

    import zstandard as z

    model = compression_quality.fit([(t, 1 - y) for t, y in labelled(300, [f"plain{i}" for i in range(80)], [f"$$${i}!!" for i in range(80)], 2)])
    texts = ["plain1 plain2", "$$$1!! " * 999, "é" * 3000, "", None, "plain1 plain2", "x"]
    make = lambda d: z.ZstdCompressor(level=3, dict_data=d and z.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
    got = {r.doc_id: r.score for r in compression_quality.score(docs(spark, texts, "score other"), model).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        parts = [raw[k : k + 1024] for k in range(0, len(raw), 1024)]
        good, bad, plain = (sum(len(make(d).compress(p)) for p in parts) for d in (model.good, model.bad, None))
        x = ((bad - good) / plain, math.log(plain / len(raw))) if raw else (0.0, 0.0)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(x[0] * model.weights[0] + x[1] * model.weights[1] + model.weights[2]))))
    assert compression_quality.score(docs(spark, []), model).count() == 0
    assert compression_quality.score(docs(spark, ["a"], "score other"), model).columns == ["doc_id", "text", "source", "other", "score"]


def test_scores_separate_held_out_labels(spark):
    """op5 and op7 on the small tables, on rows that they have not learned from."""
    import zlib

    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    for query, label, mod, left in ((queries.op5_toxicity, "toxic", 3, 1), (queries.op7_compression_quality, "quality", 5, 0)):
        rows = query(spark, d).collect()
        assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == left) for r in rows)
        known = [(labels[r.doc_id][label], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
        one, zero = [p for y, p in known if y == 1], [p for y, p in known if y == 0]
        assert sum(one) / len(one) >= 0.75 and (1 - sum(zero) / len(zero)) >= 0.7
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.7 if mod == 3 else 0.3)) for r in rows)


def test_labelled_sample(spark):
    d = docs(spark, [f"t{i}" for i in range(50)] + [None])
    lab = spark.createDataFrame([(i, i % 2 if i % 7 else None) for i in range(51)], "doc_id long, quality int")
    got = compression_quality.labelled_sample(d, lab, "quality", 10)
    assert sorted(got) == sorted(compression_quality.labelled_sample(d.repartition(7), lab.repartition(3), "quality", 10))
    assert sum(y for _, y in got) == 10 and len(got) <= 20
    twice = d.unionByName(d.withColumn("text", F.concat("text", F.lit("+"))))
    assert sorted(compression_quality.labelled_sample(twice, lab, "quality", 10)) == sorted(got)
    assert compression_quality.labelled_sample(d.limit(0), lab, "quality", 10) == []


# ---------------------------------------------------------------- 8
def test_mixing(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 2000, "a").when(F.col("id") < 2900, "b").alias("source"), F.lit(1).alias("copy"))
    out = mixing.mix(df, {"a": 1, "b": 1, "": 2}, epochs=2.0)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 1500) < 150 and abs(n["b"] - 1500) < 150 and abs(n[None] - 3000) < 250
    again = mixing.mix(df.repartition(5), {"a": 1, "b": 1, "": 2}, epochs=2.0)
    assert out.exceptAll(again).count() == 0 and again.count() == out.count()
    assert out.select("doc_id", "copy").distinct().count() == out.count()
    assert mixing.mix(df.limit(0)).count() == 0
    big = mixing.mix(df.limit(5), epochs=700.0).count()
    assert abs(big - 3500) < 300


def test_mixing_keeps_all_columns_and_orders_by_position(spark):
    df = docs(spark, ["a", None, "", "a"] * 20, "rate __source __n __slot n").withColumn("a.b", F.lit(1)).unionByName(docs(spark, ["x"], "rate __source __n __slot n").withColumn("a.b", F.lit(1)).withColumn("doc_id", F.lit(None).cast("long")))
    for most in (10_000, 0):  # rates by broadcast, and by a join over slots
        mixing_was, mixing.MAX_BROADCAST_SOURCES = mixing.MAX_BROADCAST_SOURCES, most
        try:
            out = mixing.mix(df, epochs=3.0)
            assert out.columns == [*df.columns, "copy", "position"]
            rows = out.collect()
        finally:
            mixing.MAX_BROADCAST_SOURCES = mixing_was
        assert {r["rate"] for r in rows} == {"clash"} and 150 < len(rows) < 350
        assert [r.position for r in rows] == sorted(r.position for r in rows)


def test_poisson_inverse(spark):
    import math

    got = spark.range(1).select(*[mixing.poisson_count(F.lit(u), F.lit(2.5)).alias(str(i)) for i, u in enumerate((0.01, 0.1, 0.5, 0.9, 0.9999))]).first()
    for k, u in zip(got, (0.01, 0.1, 0.5, 0.9, 0.9999)):
        cdf = lambda m: sum(math.exp(-2.5) * 2.5**i / math.factorial(i) for i in range(m + 1))
        assert cdf(k) >= u and (k == 0 or cdf(k - 1) < u)


# ---------------------------------------------------------------- 9
def test_escapes():
    for t in ("<|im_end|>", "<\\|x", "<\\\\|", "a<|b<|", "<", "<<|", ""):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
    assert chat.unescape_role(chat.escape_role("a\n%0A<|")) == "a\n%0A<|"


def test_chat_events(spark):
    e = [
        (1, 1, 1, "message", "user", "hi <|im_end|>"), (1, 2, 1, "message", "assistant", "a"), (1, 2, 2, "delta", None, "b"), (1, 2, 3, "regenerate", None, None),
        (1, 2, 4, "delta", None, "c"), (1, 2, 5, "delta", None, "d"), (1, 3, 1, "message", "user", "x"), (1, 3, 2, "edit", None, "y"), (1, 4, 1, "message", "user", "z"),
        (1, 4, 2, "delete", None, None), (None, 1, 1, "message", None, None), (2, 1, 1, "unknown", "user", "q"),
    ]
    rendered = chat.render(spark.createDataFrame(e, chat.EVENTS.replace("part bigint, ", "")))
    out = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    turns = "user\nhi <|im_end|>\nassistant\ncd\nuser\ny\n"
    assert out[1].n_turns == 3 and out[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert out[1].loss_chars == 2 and out[1].loss_sha256 == hashlib.sha256(b"cd").hexdigest()
    assert out[None].n_turns == 1 and 2 not in out


def test_chat_turns_of_any_number(spark):
    """Turns past 2^62, null ones, many rows of one turn, other columns, and no rows at all."""
    rows = [(1, 2**62, "user", "late", 0), (1, -(2**62), "user", "early", 0), (1, None, "user", "first", 0), (1, 5, None, None, 0)]
    rows += [(2, 7, "assistant", f"{i:05d}", 0) for i in range(3000)] + [(2, 8, "user", "end", 0)] + [(3, 1, "assistant", "x" * 1_000_000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message int").withColumn("part", F.lit("clash")).repartition(4)
    out = {r.conv_id: r for r in chat.read_back(chat.render(chat.events_of(df))).collect()}
    turns = "user\nfirst\nuser\nearly\n\n\nuser\nlate\n"
    assert out[1].n_turns == 4 and out[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    loss = "".join(f"{i:05d}" for i in range(3000))
    assert out[2].n_turns == 3001 and out[2].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert out[3].loss_chars == 1_000_000 and out[3].formatted_chars == 1_000_000 + len("<|im_start|>assistant\n<|im_end|>\n")
    assert chat.read_back(chat.render(chat.events_of(df.limit(0)))).count() == 0


# ---------------------------------------------------------------- 10
def test_top_k(spark):
    rnd = random.Random(8)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [1.0, 2.0]), (304, []), (None, [1.0] * 6), (7, rows[7][1]), (400, rows[0][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in vafile.top_k(df.filter("vec_id % 50 = 0"), df.repartition(4)).collect())
    import math

    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in ints:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q and len(w) == len(v))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert vafile.top_k(df.limit(0), df).count() == 0 and vafile.top_k(df, df.limit(0)).count() == 0


def test_cells_bound_scores_and_leave_out_nothing():
    import numpy as np

    rnd = np.random.default_rng(4)
    for dim, spread in ((1, 3), (6, 500), (20, 1 << 20)):
        x, q = rnd.integers(-spread, spread, (90, dim)), rnd.integers(-spread, spread, (11, dim))
        made = vafile._cells(x)
        cells, low, width = (np.frombuffer(made[c], t) for c, t in (("data", np.uint8), ("low", np.int64), ("width", np.int64)))
        least, most = vafile.bounds(q, cells.reshape(90, dim), low, width)
        score = q @ x.T
        assert (least <= 2 * score).all() and (2 * score <= most).all()
        best, kept = None, []
        for at in range(0, 90, 30):
            part = slice(at, at + 30)
            keep, best = vafile.survivors(least[:, part], most[:, part], np.zeros((11, 30), bool), 5, best)
            kept.append(keep)
        for r, keep in enumerate(np.concatenate(kept, axis=1)):
            assert set(np.argsort(-score[r], kind="stable")[:5]) <= set(np.flatnonzero(keep))
            assert dim < 20 or keep.sum() < 60


def test_top_k_of_large_vectors(spark):
    import math

    rnd = random.Random(9)
    size = lambda i: (1, 1, 1e4, 1e9, 1e15, 1e200, 1e306)[i % 7]
    rows = [(i, [rnd.uniform(-1, 1) * size(i) for _ in range(4)]) for i in range(140)]
    rows += [(200, rows[3][1]), (201, rows[4][1]), (202, [8192.0, 0.0, 0.0, 0.0]), (203, [-8192.0, 1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vafile.top_k(df, df).collect()}
    floor = lambda x: math.floor(256 * x) if math.isfinite(256 * x) else 256 * int(x)
    ints = [(i, [floor(x) for x in v]) for i, v in rows]
    assert len(got) == 5 * len(rows)
    for q, v in ints:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q)[:5]
        for r, (s, i) in enumerate(best):
            assert got[q, r + 1] == (i, -s if -(2**63) <= -s < 2**63 else None)
