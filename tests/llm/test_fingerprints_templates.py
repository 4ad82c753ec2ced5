import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelscope.llm import fingerprint as fp
from reelscope.llm import templates


@settings(max_examples=150, deadline=None)
@given(a=st.text("ab", max_size=40), b=st.text("ab", max_size=40), i=st.integers(0, 40), j=st.integers(0, 40))
def test_extension_against_plain(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    want = 0
    while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
        want += 1
    assert fp.common_extension(fp.PrefixHashes(a), i, fp.PrefixHashes(b), j) == want


def test_span_arrays_match_single_spans():
    own = fp.PrefixHashes("héllo wörld 🙂 again")
    assert own.spans(5).tolist() == [own.span(k, k + 5) for k in range(own.length - 4)]


def test_likeness():
    rng = np.random.default_rng(1)
    text = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    a, b = text(4000), text(4000)
    half = a[:2000] + b[:2000]
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(a)) == 1.0
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) == 0.0
    assert 0.3 < fp.likeness(fp.fingerprint(a), fp.fingerprint(half)) < 0.7
    assert fp.likeness(fp.fingerprint(""), fp.fingerprint("x")) == 0.0 and fp.fingerprint("") == fp.fingerprint(None)


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    return [(i, t or "", (order[(k + 1) % len(order)][1] or "")) for k, (i, t) in enumerate(order)]


@pytest.mark.parametrize("block", [500, 7, 1])
def test_neighbours_against_sorting(spark, monkeypatch, block):
    monkeypatch.setattr(fp, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = [(int(k) * 3, "t" * int(rng.integers(0, 30)) + f"é{k}") for k in rng.permutation(90)] + [(500, "same"), (500, "same"), (501, None), (502, ""), (None, "no id"), (None, "no id, later"), (600, "l" * 50_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, block string")
    got = fp.fingerprinted(docs).collect()
    want = sorted((str(i), hashlib.sha256(fp.edited(t, n).encode()).hexdigest()) for i, t, n in expected(rows))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got) == want
    by_text = {}
    for i, t, _ in expected(rows):
        by_text.setdefault(str(i), t)
    same = [r["fingerprint"] for r in got if r["doc_id"] == 500]
    assert len(set(same)) == 1 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert all(r["common_prefix"] >= r["n_chars"] - r["n_chars"] // 2 for r in got)


def test_few_rows(spark):
    docs = spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")
    (only,) = fp.fingerprinted(docs).collect()
    assert only["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and only["near_next"] == 1.0
    assert fp.fingerprinted(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "b"), (None, "a")], "doc_id long, text string")
    assert fp.fingerprinted(nulls).count() == 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>x";</script></head><body>
<header><div class="logo">Site</div></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="page"><aside class="sidebar">Side {k}</aside><div class="ad">Buy {k}</div><{main}><h1>Title {k} &amp; more</h1>{body}</{main}><form>Mail <input name=x></form>
<div class="comments"><p>Nice {k}</p></div></div><!-- <p>hidden</p> --><footer>&copy; Site</footer></body></html>"""


def page(k, main="article"):
    body = "".join(f"<p>Part {j} of <b>{k}</b>\n  is here.<br>Next{'</p>' if j % 2 else ''}" for j in range(3 + k % 3))
    return PAGE.format(k=k, main=main, body=body)


def answer(k):
    return "\n".join([f"Title {k} & more", *(f"Part {j} of {k} is here. Next" for j in range(3 + k % 3))])


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, text string, host string")


def test_extraction_with_and_without_templates(spark):
    rows = [(k, f"http://big.example/{k}", page(k)) for k in range(30)] + [(100 + k, f"http://plain.example/{k}", page(k, "section")) for k in range(20)]
    rows += [(200, "http://alone.example/1", page(1)), (201, None, page(2)), (202, "::bad[", page(3))]
    got = {r["page_id"]: r for r in templates.extracted(frame(spark, rows)).collect()}
    assert all(got[k]["text"] == answer(k) for k in range(30))
    assert all(got[100 + k]["text"] == answer(k) for k in range(20))
    assert [got[k]["text"] for k in (200, 201, 202)] == [answer(1), answer(2), answer(3)]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_copies_of_one_article_stay(spark):
    rows = [(k, f"http://copies.example/{k}", page(1)) for k in range(40)]
    assert {r["text"] for r in templates.extracted(frame(spark, rows)).collect()} == {answer(1)}


def test_awkward_pages(spark):
    rows = [(1, "http://h/1", None), (2, "http://h/2", ""), (2, "http://h/2", ""), (3, "http://h/3", "just text &lt; <"), (4, "http://h/4", "<p>cut <a href='x"), (5, "http://h/5", "<div>" * 60_000 + "deep" + "</x>" * 60_000 + "<center>" * 60_000), (6, "http://h/6", "<p>a > b & c</p><script>never closed"), (None, "http://h/7", "<p>x</p>"), (8, "http://h/8", "<p>" + "long " * 100_000)]
    got = [(r["page_id"], r["text"]) for r in templates.extracted(frame(spark, rows)).collect()]
    want = {1: "", 2: "", 3: "just text < <", 4: "cut", 5: "deep", 6: "a > b & c", None: "x", 8: ("long " * 100_000).strip()}
    assert len(got) == len(rows) and all(want[i] == t for i, t in got)
    assert templates.extracted(frame(spark, [])).count() == 0


def test_vectors_make_classes(spark):
    rows = [(k, f"http://big.example/{k}", page(k)) for k in range(12)]
    vectors = {r["path"]: r for r in templates.token_vectors(frame(spark, rows)).collect()}
    once = [p for p in vectors if p.endswith(("article", "footer", "nav", "h1"))]
    assert len(once) == 4 and len({(vectors[p]["v1"], vectors[p]["v2"]) for p in once}) == 1
    paragraphs = next(r for p, r in vectors.items() if p.endswith("article>p"))
    assert paragraphs["count"] == sum(3 + k % 3 for k in range(12)) and paragraphs["v1"] != vectors[once[0]]["v1"]


def test_no_varying_slot_is_lost(spark):
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    aside = lambda k: f"<div class=note>Note {k}</div>" if k % 5 < 2 else ""
    html = lambda k: f"<html><body><div class=top><p>Our site</p></div><article><h1>Title {k}</h1><div class=lede>Lede {k}</div><div class=body><p>{words(k, 80)}</p></div>{aside(k)}<div class=appendix>End {k}</div></article></body></html>"
    rows = [(k, f"http://{'big' if k < 20 else 'small'}.example/{k}", html(k)) for k in range(24)]
    got = {r["page_id"]: r["text"] for r in templates.extracted(frame(spark, rows)).collect()}
    note = lambda k: [f"Note {k}"] if k % 5 < 2 else []
    assert all(got[k] == "\n".join([f"Title {k}", f"Lede {k}", words(k, 80), *note(k), f"End {k}"]) for k in range(24))


WRAPPED = [
    "<body class='single no-sidebar'>{}</body>", "<body class=sidebar>{}</body>", "<div id=page class='has-sidebar'>{}</div>", "<body><form id=aspnetForm>{}<form>Mail</form></form></body>", "<div class=sidebar>{}</div>", "<aside>{}</aside>",
    "<article class='post comments-closed'>{}</article>", "<svg/>{}<svg><text>no</text></svg>", "<object data=x>{}", "<canvas>{}<canvas>no</canvas>", "<select><option>{}<select><option>no</select>", "<script src='a' />{}<script>no()</script>", "<title/>{}", "<svg><svg/><text>no</text></svg>{}",
]


@pytest.mark.parametrize("wrap", WRAPPED)
def test_wrappers_lose_nothing(wrap):
    assert templates.main_text(wrap.format("<h1>Head</h1><p>Some text.</p>")).split("\n")[:2] == ["Head", "Some text."]
    assert "no" not in templates.main_text(wrap.format("<h1>Head</h1><p>Some text.</p>"))


def test_names_of_boilerplate_are_skipped():
    names = ["sidebar", "site-nav", "cookie-notice", "post-comments", "navbar", "related_posts", "ad-box-3", "comment-list"]
    assert templates.main_text("<p>Text.</p>" + "".join(f"<div class={x}>no</div>" for x in names) + "<form>no</form><select><option>no</select><button>no</button>") == "Text."


def test_fixed_slots_of_layouts(spark):
    fixed = "<div class=x><ul><li>One</li><li>Two</li></ul><p>Our guide</p></div>"
    html = lambda k: f"<html><body><div class={'abc'[k % 3]}><h1>Title {k}</h1><div class=t><p>Text {k}</p></div>{fixed}</div></body></html>"
    copy = "<html><body><div class=copied><h1>Same</h1><p>Words</p></div></body></html>"
    rows = [(k, f"http://layouts.example/{k}", html(k)) for k in range(36)] + [(100 + k, f"http://layouts.example/c{k}", copy) for k in range(12)]
    got = {r["page_id"]: r["text"] for r in templates.extracted(frame(spark, rows)).collect()}
    assert all(got[k] == f"Title {k}\nText {k}" for k in range(36))
    assert all(got[100 + k] == "Same\nWords" for k in range(12))


def plain_fixed(htmls):
    """The fixed paths of one host's pages, from whole occurrence vectors; None without a template."""
    import re
    from math import gcd

    pages = []
    for html in htmls:
        own = {}
        for text, node in templates.blocks(html):
            if node.skipped < templates.NO_TEXT:
                found = own.setdefault(node.path, [0, [], False, node.main])
                found[0] += text is None
                found[1] += [text] if text is not None else []
                found[2] |= node.skipped != templates.KEPT
        pages.append(own)
    paths = {p for own in pages for p in own}
    vector = {p: tuple(own[p][0] if p in own else 0 for own in pages) for p in paths}
    texts = {p: [tuple(own[p][1]) for own in pages if p in own and own[p][1]] for p in paths}
    stands = {p: sum(p in own for own in pages) for p in paths}
    named = {p: any(own[p][2] for own in pages if p in own) for p in paths}
    inner = {p: any(own[p][3] for own in pages if p in own) for p in paths}
    told = [p for p in paths if texts[p]]
    differing = lambda p: len(set(texts[p]))
    varied = [p for p in told if not named[p] and differing(p) > 1]
    if len(pages) < templates.SUPPORT or not varied:
        return None
    weight = lambda p: (sum(len(x) for t in texts[p] for x in t) * differing(p) / stands[p], p)
    main = max((p for p in told if not named[p]), key=weight)
    within = lambda p, c: (p + ">").startswith(c + ">")
    root = tuple([1] * len(pages))
    classes = {vector[p] for p in paths if p and not named[p] and set(vector[p]) <= {0, 1} and any(within(q, p) for q in varied)} | {root}

    def reduced(v):
        n = gcd(*v)
        return tuple(x // n for x in v) if n else v

    def of_template(p):
        if stands[p] < templates.SUPPORT or p == main or not (stands[p] == len(pages) or (reduced(vector[p]) in classes and set(reduced(vector[p])) <= {0, 1})):
            return False
        turns = not inner[p] and templates.TURNS * differing(p) * stands[main] <= differing(main) * stands[p]
        return differing(p) == 1 or turns

    rich = [p for p in told if not of_template(p)]
    return {p for p in told if of_template(p) and not any(within(q, re.sub(templates.FLOW, "", p)) for q in rich)}


def prose(k, n=30):
    return " ".join(f"w{k}x{j}" for j in range(n))


MENU = "<div class=qa><ul><li>One</li><li>Two</li></ul></div>"
#: Pages, and the text wanted, of hosts whose furniture has names that say nothing.
SKELETONS = {
    "no article element": (lambda k: f"<body>{MENU}<div class=qb><h1>T {k}</h1><p>{prose(k)}</p></div><div class=qc>About us</div></body>", lambda k: f"T {k}\n{prose(k)}"),
    "furniture within the article": (lambda k: f"<body>{MENU}<article><h1>T {k}</h1><div class=qd>Write to us</div><p>{prose(k)}</p><div class=qe><p>Read on</p></div></article></body>", lambda k: f"T {k}\n{prose(k)}"),
    "blocks that take turns": (lambda k: f"<body>{MENU}<div class=qf><a>Offer {k % 4}</a></div><div class=qb><h1>T {k}</h1><p>{prose(k)}</p></div><div class=qg><ul><li>More {k % 3}</li><li>Next {k % 3}</li></ul></div></body>", lambda k: f"T {k}\n{prose(k)}"),
    "copies of one article": (lambda k: f"<body>{MENU}<div class=qb><h1>T {k % 8}</h1><p>{prose(k % 8)}</p></div><div class=qc>About us</div></body>", lambda k: f"T {k % 8}\n{prose(k % 8)}"),
    "two layouts": (lambda k: f"<body><div class=a{'xy'[k % 2]}>{MENU}<h1>T {k}</h1><div class=qb><p>{prose(k)}</p></div><div class=qc>Of this kind</div></div></body>", lambda k: f"T {k}\n{prose(k)}"),
    "optional parts": (lambda k: f"<body>{MENU}<article><p>{prose(k)}</p>{f'<div class=qh>Part {k}</div>' if k % 3 else ''}</article></body>", lambda k: prose(k) + (f"\nPart {k}" if k % 3 else "")),
}


@pytest.mark.parametrize("name", SKELETONS)
@pytest.mark.parametrize("lists", [True, False])
def test_deduced_classes_remove_furniture(spark, name, lists, monkeypatch):
    """With word and tag lists emptied, too, and as a plain deduction has it; a host of two pages tells nothing."""
    import re

    if not lists:
        for x in ("BOILER", "INNER", "HEADER"):
            monkeypatch.setattr(templates, x, re.compile("(?!)"))
        monkeypatch.setattr(templates, "SKIPPED", frozenset())
    page_of, answer_of = SKELETONS[name]
    rows = [(k, f"http://big.example/{k}", page_of(k)) for k in range(40)] + [(100 + k, f"http://WWW.Two.example:80/{k}", page_of(k)) for k in range(2)]
    pages = frame(spark, rows)
    got = {r["page_id"]: r["text"] for r in templates.extracted(pages).collect()}
    assert all(got[k] == answer_of(k) for k in range(40))
    assert all(answer_of(k).split("\n")[-1] in got[100 + k] for k in range(2))
    found = {r["host"]: set(r["fixed"]) for r in templates.templates(pages).collect()}
    assert found == {"big.example": plain_fixed([h for _, u, h in rows if "big" in u])} and found["big.example"]


def test_names_within_an_article_are_hints_only():
    assert templates.main_text("<article><p>Body</p><div class=notice>Real text.</div><p class='lead share'>Lead.</p><div class=search-results>Found.</div><div id=side>At the side.</div></article>") == "Body\nReal text.\nLead.\nFound.\nAt the side."
    assert templates.main_text("<article><p>Body</p><div class=ad>Buy</div><section id=comments><p>Nice</p></section><div class=related-posts><ul><li>Other</li></ul></div></article>") == "Body"


def test_shared_pages_lose_furniture_by_classes_alone(spark, monkeypatch):
    """On the shared table a host with pages enough needs no list."""
    import os
    import re

    folder = "/root/testdata/sf0.1/pages.parquet"
    if not os.path.exists(folder):
        pytest.skip("the shared test tables are not here")
    pages = spark.read.parquet(folder).filter("url LIKE '%//blog.tionsh.example.com%'")
    with_lists = {r["page_id"]: r["text"] for r in templates.extracted(pages).collect()}
    for x in ("BOILER", "INNER", "HEADER"):
        monkeypatch.setattr(templates, x, re.compile("(?!)"))
    monkeypatch.setattr(templates, "SKIPPED", frozenset())
    without = {r["page_id"]: r["text"] for r in templates.extracted(pages).collect()}
    assert len(with_lists) == 320 and without == with_lists


def plain_least(text):
    """The least span hashes by the definition: polynomial hashes of every span, summed anew."""
    width, prime_of = min(fp.WIDTH, len(text)), list(zip(fp.PRIMES, fp.BASES, strict=True))
    found = set()
    for k in range(len(text) - width + 1):
        value = 0
        for prime, base in prime_of:
            value = value << 31 | sum((ord(c) + 1) * pow(base, j, prime) for j, c in enumerate(text[k : k + width])) % prime
        found.add(int(fp.mixed(np.array([value], np.uint64))[0]) >> 24)
    return sorted(found)[: fp.KEEP] if text else []


def plain_likeness(a, b):
    if a == b:
        return 1.0
    a, b = plain_least(a), plain_least(b)
    if not a or not b:
        return float(len(a) == len(b))
    union = sorted(set(a) | set(b))
    if max(len(a), len(b)) == fp.KEEP:
        union = union[: fp.KEEP]
    share = sum(x in set(a) and x in set(b) for x in union) / len(union)
    return 2 * share / (1 + share)


def test_likeness_against_plain(spark):
    rng = np.random.default_rng(5)
    text = lambda n: "".join("abcde é"[x] for x in rng.integers(0, 7, n))
    base = text(400)
    rows = [(1, base), (2, base[:300] + text(100)), (3, text(10)), (4, None), (5, base), (6, base), (7, text(130)), (8, "x")]
    got = {r["doc_id"]: r for r in fp.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = [t or "" for _, t in rows]
    for k, own in enumerate(texts):
        following = texts[(k + 1) % len(texts)]
        assert got[k + 1]["near_next"] == pytest.approx(plain_likeness(own, following))
        assert got[k + 1]["near_edited"] == pytest.approx(plain_likeness(own, fp.edited(own, following)))
        assert fp.likeness(got[k + 1]["fingerprint"], got[(k + 1) % len(rows) + 1]["fingerprint"]) == pytest.approx(got[k + 1]["near_next"])
