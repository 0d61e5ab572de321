import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logsift.llm import media, ngram_lm, pii, toxicity, url_filter
from logsift.llm.html_text import extract, main_text


def test_kneser_ney_is_exact_and_sums_to_one(spark):
    texts = ["the cat sat on the mat", "the dog sat", "a cat\tate the dog", "the the the", "", None, "Cat DOG é"]
    rows = [(i, t) for i, t in enumerate(texts * 3 + [f"w{i} the w{i * 7 % 5}" for i in range(30)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = ngram_lm.train(docs.where("doc_id % 4 <> 1"))
    got = {r.doc_id: r for r in ngram_lm.score(docs, model, F.col("doc_id") % 4 == 1).collect()}
    words = lambda t: [w for w in re.sub("[A-Z]+", lambda m: m[0].lower(), t or "").split()] + ["</s>"]
    train = [words(t) for i, t in rows if i % 4 != 1]
    count = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t))
    before, after = Counter(w for _, w in pairs), defaultdict(list)
    for (v, _), n in pairs.items():
        after[v].append(n)
    tally = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    d, e = ngram_lm.discounts(*tally(pairs)), ngram_lm.discounts(*tally(before))
    left = sum(e[min(n, 3)] for n in before.values()) / len(pairs)

    def p(v, w):
        low = max(before[w] - e[min(before[w], 3)], 0) / len(pairs) + left / (len(count) + 1)
        if v not in after:
            return low
        n = pairs[v, w]
        return max(n - d[min(n, 3)], 0) / sum(after[v]) + sum(d[min(x, 3)] for x in after[v]) / sum(after[v]) * low

    assert math.isclose(sum(p("the", w) for w in count) + p("the", "?"), 1)
    total = sum(count.values())
    for i, t in rows:
        w = words(t)
        assert got[i].n_tokens == len(w) and got[i].n_known == sum(count[x] > 0 for x in w) and got[i].train_tokens == total
        assert math.isclose(got[i].score, sum(math.log10(p(v, x)) for v, x in zip(["<s>", *w], w)), rel_tol=1e-9)
        assert math.isclose(got[i].base_score, sum(math.log10((count[x] + 0.5) / (total + 0.5 * (len(count) + 1))) for x in w), rel_tol=1e-9)


def test_kneser_ney_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    rows = ngram_lm.score(docs, ngram_lm.train(docs.where("1 = 0")), F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in sorted(rows, key=lambda r: -r.n_tokens)] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert ngram_lm.score(docs.where("1 = 0"), ngram_lm.train(docs), F.lit(True)).count() == 0


def test_media_round_trip(spark):
    rows = [(1, "é" * 96), (2, None), (2, ""), (None, "x" * 400), (5, "a" * 200_000)]
    path = media.write_media(spark.createDataFrame([(*r, b"m") for r in rows], "doc_id long, text string, media binary"))
    back = spark.read.format("mediapack").option("rangeBytes", 1).load(path)
    assert sorted(((r.doc_id, media.decode_png(bytes(r.media))[: r.n_bytes].decode()) for r in back.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    got = {r.n_bytes: r for r in media.media_features(media.read_media(spark, path)).collect()}
    assert got[192].payload_bytes == 192 and got[0].payload_bytes == 192 and got[400].payload_bytes == 576
    payload = ("x" * 400).encode() + b" " * 176
    assert got[400].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[400].tail_crc32 == zlib.crc32(payload[-16:])


def test_media_damage_is_found_and_lists_are_trusted(spark):
    docs = spark.createDataFrame([(i, f"text {i}" * 50) for i in range(20)], "doc_id long, text string").coalesce(1)
    path = media.write_media(docs)
    (name,) = (n for f in media._lists(path) for n in media._names(path, f))
    open(f"{path}/stray.mpk", "wb").write(b"not listed")
    assert media.read_media(spark, path).count() == 20
    with open(f"{path}/{name}", "r+b") as f:
        f.seek(100)
        f.write(b"\0\0\0\0")
    with pytest.raises(Exception, match="can't be read"):
        media.read_media(spark, path).collect()
    assert media.media_features(media.read_media(spark, media.write_media(docs.where("1 = 0")))).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div class="cookie-notice"><p>We use cookies, really, many, and long ones, for your comfort.</p></div>
<article><h1>Title &amp; more</h1><p>First,\n paragraph&nbsp;with <b>bold</b> and <a href=x>a link</a>, and commas, long enough.<p>Second one, that is unclosed, with a few more words in it.
<form><p>Subscribe, to, our, letter, now, please, it, is, free</p></form><script>var x = "<p>no</p>";</script></article>
<aside><p>Related, stories, and, many, more, commas, here, to, fool, us</p></aside><section id="comments"><p>I, like, this, very, much, indeed, yes, so, much</p></section><footer>&copy; me</footer></body></html>"""


def test_media_writes_append_or_replace(spark):
    path = media.write_media(spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string"))
    media.write_media(spark.createDataFrame([(3, "three")], "doc_id long, text string"), path)
    ids = lambda: sorted(r.doc_id for r in media.read_media(spark, path).collect())
    assert ids() == [1, 2, 3]
    media.write_media(spark.createDataFrame([(4, "four")], "doc_id long, text string"), path, mode="overwrite")
    assert ids() == [4]


def test_media_members_are_tried_again(tmp_path):
    import io

    good = b"x" * 100
    (tmp_path / "a.mpk").write_bytes(b"head" + good)

    class Flaky(io.BytesIO):
        def read(self, n=-1):
            raise OSError("lost")

    assert media.MediaReader._member(Flaky(), str(tmp_path / "a.mpk"), 4, 100, zlib.crc32(good)) == good
    with pytest.raises(OSError):
        media.MediaReader._member(Flaky(), str(tmp_path / "a.mpk"), 4, 100, 1, tries=1)


def test_media_features_are_those_of_the_samples(spark):
    texts = ["abc", "é" * 500, "", "word " * 400]
    got = {r.n_bytes: r.feature for r in media.media_features(media.read_media(spark, media.write_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))).collect()}
    for t in texts:
        x = t.encode()
        x += b" " * (-len(x) % 192 if x else 192)
        mean = sum(x) / len(x)
        sd = math.sqrt(sum((b - mean) ** 2 for b in x) / len(x))
        entropy = -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values())
        sums = [sum(x[c::192]) for c in range(0, 192, 3)]
        bits = "".join("01"[b > a] for a, b in zip(sums, sums[1:])).ljust(64, "0")
        values = dict(f.split("=") for f in got[len(t.encode())].split(";"))
        assert abs(float(values["mean"]) - mean) < 1e-3 and abs(float(values["sd"]) - sd) < 1e-3 and abs(float(values["entropy"]) - abs(entropy)) < 1e-3
        assert int(values["slope"], 16) == int(bits, 2)


def test_html():
    assert main_text(PAGE) == "Title & more\nFirst, paragraph with bold and a link, and commas, long enough.\nSecond one, that is unclosed, with a few more words in it."
    assert [main_text(x) for x in (None, "", "<p>", "plain", "<p>Short", "<div><p>a</div><!-- <p>b", "&amp", "<p>cut <a hre")] == ["", "", "", "plain", "Short", "a", "&", "cut"]
    assert main_text("<p>a</p>" * 5000).count("\n") == 4999


def test_html_keeps_long_articles_whole():
    words = lambda k: f"Paragraph {k}, with commas, and, so, on, and enough words to count as a full one."
    for n in (5, 30, 300):
        body = [words(k) for k in range(n)]
        ps = "".join(f"<p>{p}</p>" for p in body)
        around = "<body><nav><a href=/>Home</a></nav>{}<footer>me</footer></body>"
        two = "<p>One, short section.</p><p>Of two.</p>"
        assert main_text(around.format(f"<article><header><h1>T</h1></header><div class=entry-content>{ps}</div></article>")).split("\n") == ["T", *body]
        assert main_text(around.format(f"<article><section>{two}</section><section>{ps}</section><div><section>{two}</section></div></article>")).split("\n") == ["One, short section.", "Of two.", *body, "One, short section.", "Of two."]
        assert main_text(around.format(f"<main><div><h1>T</h1></div><div><div>{ps}</div></div><div>End</div></main>")).split("\n") == ["T", *body, "End"]
        assert main_text(around.format(f"<div><div><h1>T</h1></div><div><div>{two}</div><div>{ps}</div></div><div>End</div></div>")).split("\n") == ["T", "One, short section.", "Of two.", *body, "End"]
        links = "<ul><li><a href=1>Some other story</a><li><a href=2>And another</a></ul>"
        assert main_text(around.format(f"<div><div><h1>T</h1></div><div>{ps}</div><div>{links}</div>Loose text</div>")).split("\n") == ["T", *body, "Loose text"]
        assert main_text(around.format(f"<div>{links}</div><article>{ps}</article><div>{links}</div>")).split("\n") == body


def test_html_wrappers_named_like_boilerplate():
    body = [f"Paragraph {k}, with commas, and, so, on, and enough words to count as a full one." for k in range(6)]
    ps = "".join(f"<p>{p}</p>" for p in body)
    noise = "<div class='site-footer'><p>All, rights, are, reserved, for, ever and ever.</p></div><ol class=comment-list><li><article class=comment-body><p>I, like, this, very, much.</p></article></ol><div id=cookieNotice><p>We, use, cookies, for, your, comfort, always.</p></div><div class='widget sidebar-left'><p>Other, things, to, read, here, today.</p></div>"
    for wrapper in ("<div class='content-sidebar-wrap'>", "<div id=page class='site has-sidebar'>", "<div class='layout no-sidebar'>", "<div class=sidebar>", "<div class='site-header'>", "<section id='related-work'>", "<div class='social-policy'>", "<div role=banner class=widget>"):
        for inner in (ps, f"<article>{ps}</article>", f"<main><div>{ps}</div></main>"):
            assert main_text(f"<body><nav><a href=/>Home</a></nav>{wrapper}{inner}</div></section></div>{noise}</body>").split("\n") == body, (wrapper, inner[:9])
    assert main_text(f"<article>{ps}<section id='related-work'><p>Others wrote.</p></section><div class='social-policy'><p>A policy.</p></div><div class=share-buttons>Share</div>{noise}</article>").split("\n") == [*body, "Others wrote.", "A policy."]
    many = "<p>I, like, this, very, much, and, more, so, than, all.</p>" * 90
    assert main_text(f"<div class=sidebar-layout><div class=sidebar>{ps}</div></div><div id=comments>{many}</div><div class=comments><article>{many}</article></div>").split("\n") == body


def test_html_elements_that_never_close():
    for tag in ("svg", "object", "iframe", "noscript", "canvas", "select", "math", "template", "xmp"):
        got = main_text(f"<body><article><p>First, with commas, and so on.<{tag} class=x><p>Second, with commas, and so on.</article>").split("\n")
        assert got == ["First, with commas, and so on.", "Second, with commas, and so on."], tag
    for tag in ("script", "style", "textarea", "title"):
        assert main_text(f"<article><p>First, with commas, and so on.</p><{tag}><p>Second, of more.</p></article>") == "First, with commas, and so on.", tag


def test_html_deep_and_long_pages_take_linear_time():
    def took(n: int, page) -> float:
        began = time.process_time()
        main_text(page(n))
        return time.process_time() - began

    for page in (lambda n: "<div>" * n + "<p>Some, text, here.</p></i></em>" * 50 + "x</section>" * n, lambda n: "<article>" + "<svg><p>Some, text of it.</p>" * n, lambda n: "<div><header>" * n + "<p>Words, and words.</p>" * n):
        took(500, page)
        assert took(8000, page) < 0.5 + 12 * took(1000, page)
    assert main_text("<article><p>" + "word, " * 300_000 + "</p></article>").count("word,") == 300_000


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 9), (1, "u", PAGE, 9), (None, None, None, 1)], "page_id long, url string, html string, n_chars int")
    assert sorted((r.n_chars, r.page_id or 0) for r in extract(pages).collect()) == [(0, 0), (len(main_text(PAGE)), 1), (len(main_text(PAGE)), 1)]
    assert extract(pages.where("1 = 0")).count() == 0


def test_urls_by_rule(spark):
    urls = ["http://A.Example.COM/en/1?x", "https://example.com/en/77#t", "http://b.net/de/1", "http://x.example.net/de/81", "http://example.org/es/", "http://notexample.com/en/7", "http://com/en/", "x", None, "http://h", "http://x.org/fr/2", "ftp://u@h:1/p?q://z"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got[0] == ("a.example.com", "/en/1", "com/en/", "block") and got[1][2:] == ("example.com/en/7", "allow")
    assert got[2][2:] == ("net/de/", "allow") and got[3][2:] == ("example.net/de/8", "block") and got[4][2:] == ("org/es/", "block")
    assert got[5][2] == "com/en/" and got[6][:3] == ("com", "/en/", "com/en/")
    assert got[7] == got[8] == ("", "", None, "allow") and got[9][:2] == ("h", "") and got[10][2:] == (None, "allow") and got[11][:2] == ("u@h:1", "/p")
    assert url_filter.judge(pages.where("1 = 0")).count() == 0


def test_url_templates(spark):
    rules = [("block", "h", "/bad/a"), ("block", "h", "/bad/b"), ("allow", "h", "/good/")]
    urls = [f"http://h/bad/{c}{i}" for c in "abc" for i in range(20)] + [f"http://h/good/{i}" for i in range(20)] + [f"http://h/user/{'xyz'[i % 3]}{chr(97 + i // 26)}{chr(97 + i % 26)}/p" for i in range(200)]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules)
    by = {r.path: r for r in got.select(F.regexp_replace("path", r"\d+", "0").alias("path"), "verdict", "template").distinct().collect()}
    assert by["/bad/a0"].template == by["/bad/b0"].template != by["/good/0"].template  # alike in labels: merged
    assert by["/bad/a0"].verdict == "block" and by["/good/0"].verdict == "allow"
    assert got.where("path like '/user/%'").select("template").distinct().count() == 1  # many rare children: a wildcard


def brute_verdicts(pages, rules):
    """The template tree by recursion, in plain Python."""
    seen, rows = defaultdict(lambda: [0, 0, 0]), []
    for page_id, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h, p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, default=None)
        template = "/".join(re.sub("[0-9]+", "*", re.sub("^[0-9a-fA-F-]{16,}$", "*", x)) for x in path.split("/"))
        rows.append((page_id, host, path, rule and rule[1] + rule[2], rule and rule[3], template))
        n = seen[host, template]
        n[0] += 1
        n[1] += bool(rule) and rule[3] == "block"
        n[2] += bool(rule) and rule[3] == "allow"
    now = {k: ("", k[1].split("/")) for k in seen}
    for k in range(max((len(x) for _, x in now.values()), default=0)):
        kids = defaultdict(lambda: [0, 0, 0])
        for key, (final, parts) in now.items():
            if k < len(parts):
                kids[key[0], final, parts[k]] = [a + b for a, b in zip(kids[key[0], final, parts[k]], seen[key])]
        parents = defaultdict(list)
        for (host, final, _), n in kids.items():
            parents[host, final].append(n)
        after = {}
        for key, (final, parts) in now.items():
            if k < len(parts):
                all_, (n, b, a) = parents[key[0], final], kids[key[0], final, parts[k]]
                total, bad, good = (sum(x[i] for x in all_) for i in range(3))
                own, rest = b + a, bad + good - b - a
                p, q, both = (b + 1) / (own + 2), (bad - b + 1) / (rest + 2), (bad + 2) / (own + rest + 4)
                alike = abs(p - q) <= url_filter.Z * math.sqrt(both * (1 - both) * (1 / (own + 2) + 1 / (rest + 2)))
                variable = len(all_) > url_filter.MANY and n <= url_filter.RARE * total / len(all_)
                merged = sum(x[1] + x[2] >= url_filter.LEAST for x in all_) > 1 and own >= url_filter.LEAST and rest >= url_filter.LEAST and alike
                final = final + ("/" if k else "") + ("*" if variable or merged else parts[k])
            after[key] = (final, parts)
        now = after
    leaves = defaultdict(lambda: [0, 0])
    for key, (final, _) in now.items():
        leaves[key[0], final][0] += seen[key][1]
        leaves[key[0], final][1] += seen[key][2]
    out = []
    for page_id, host, path, rule, verdict, template in rows:
        final = now[host, template][0]
        b, a = leaves[host, final]
        purity = (b + url_filter.PRIOR * url_filter.WEIGHT) / (b + a + url_filter.WEIGHT)
        out.append((page_id, host, path, rule, verdict or ("block" if purity >= url_filter.REJECT else "allow"), final))
    return sorted(out)


def test_urls_equal_brute_force(spark):
    draw = random.Random(8)
    rules = [("block", "h1", "/a/b"), ("allow", "h1", "/a/c/"), ("block", "org", "/x"), ("allow", "h2.org", "/x/y"), ("block", "h2.org", "/q")]
    names = ["a", "b", "c", "x", "y", "q", "item-7", "id99", "0123456789abcdef0", "", "ü"]
    urls = [f"http://{draw.choice(['h1', 'H2.org', 's.h2.org', 'h3'])}/" + "/".join(draw.choice(names) + (chr(97 + draw.randrange(26)) * draw.randrange(3)) for _ in range(draw.randrange(6))) + draw.choice(["", "?k=1", "#t"]) for _ in range(1500)]
    urls += [f"https://h1/user/{i:b}{chr(97 + i % 26)}{chr(97 + i // 26)}/z" for i in range(300)] + ["http://deep/" + "/".join("ab"[i % 2] for i in range(40)) + end for end in ("/k", "/l")]
    pages = list(enumerate(urls))
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), rules)
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict, r.template) for r in got.collect()) == brute_verdicts(pages, rules)


def test_urls_of_any_depth(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "DEPTH", 5)
    urls = ["http://h/" + "/".join("x" * 5000), "http://h/" + "/".join("x" * 5000) + "/y", "http://h/a/b/c/d/e/f", "http://g"]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert len(got) == 4 and all(r.template == r.path and r.verdict == "allow" for r in got.values())


PRIVATE = [
    (1, "Write to bob.smith@mail.example.com or +1 (262) 555-3752, ip 10.2.3.4. Card 4111 1111 1111 1111."),
    (2, "Mr. John Smith met Mrs. Anna Smith. Later John and Smith left; bob.smith@mail.example.com"),
    (3, "clean text 2024 v1.2.3 and 555"), (4, None), (5, ""), (6, "г-н Иван Петров, SSN 123-45-6789, DE89 3704 0044 0532 0130 00"), (6, "4366498947947848"),
]


def test_personal_data(spark):
    docs = spark.createDataFrame([(*r, "c") for r in PRIVATE], "doc_id long, text string, map string")
    got = sorted(((r.doc_id, r.text) for r in pii.replace_personal(docs, "key").collect()), key=repr)
    again = sorted(((r.doc_id, r.text) for r in pii.replace_personal(docs.repartition(3), "key").collect()), key=repr)
    assert got == again != sorted(((r.doc_id, r.text) for r in pii.replace_personal(docs, "other").collect()), key=repr)
    texts = dict(got[::-1])
    assert texts[3] == PRIVATE[2][1] and texts[4] is None and texts[5] == ""
    for secret in ("bob.smith@mail", "262) 555", "10.2.3.4", "4111 1111", "John", "Smith", "Anna", "Иван", "Петров", "123-45-6789", "3704", "4366498947947848"):
        assert not any(secret in (t or "") for _, t in got)
    m = re.fullmatch(r"Write to (\w+\.\w+@\w+\.example\.\w+) or \+1 \(\d{3}\) \d{3}-\d{4}, ip (?:24\d|25[0-4])(?:\.\d+){3}\. Card (\d{4} \d{4} \d{4} \d{4})\.", texts[1])
    digits = [int(c) for c in m[2][::-1] if c != " "]
    assert m and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    n = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)\. Later (\w+) and (\w+) left; (\S+)", texts[2])
    assert n[1] == n[5] and n[2] == n[4] == n[6] and n[1] != n[3] and n[7] == m[1]
    assert re.search(r"г-н [А-Я][а-я]{3} [А-Я][а-я]{5}", " ".join(t or "" for _, t in got))
    assert pii.replace_personal(docs.where("1 = 0"), "key").count() == 0


def test_names_of_one_person_across_documents(spark):
    texts = ["Mr. Martin Keller came.", "Then Mr. Martin left, and Martin slept.", "Mrs. Keller and Dr. Martin", "Mr. McDonald, Mrs. O'Brien; O'Brien", "Dr. J. Smith and Dr. J.Smith", "MR. SMITH", "MS Word, SR Flip", "г-н Ли", "x" * 300_000 + " Mr. Martin", None, ""]
    names = ["row", "names", "found", "pattern", "text_id", "kind", "value", "_map", "n", "a.b"]
    docs = spark.createDataFrame([(i, t, *names) for i, t in enumerate(texts)], ", ".join(f"`{c}` string" if k > 1 else c for k, c in enumerate(["doc_id long", "text string", *names])))
    out = pii.replace_personal(docs, "k", count="how many")
    assert out.columns == [*docs.columns, "how many"] and out.where("`a.b` = 'a.b' and row = 'row' and n = 'n'").count() == len(texts)
    got = {r.doc_id: r.text for r in out.collect()}
    martin, keller = got[0].removeprefix("Mr. ").removesuffix(" came.").split()
    assert got[1] == f"Then Mr. {martin} left, and {martin} slept." and got[2] == f"Mrs. {keller} and Dr. {martin}" and got[8].endswith(f" Mr. {martin}") and len({martin, keller, "Martin", "Keller"}) == 4
    assert "McDonald" not in got[3] and "Brien" not in got[3] and got[3].split()[3].rstrip(";") == got[3].split()[4]
    assert got[4].split()[:2] == ["Dr.", "J."] and "Smith" not in got[4] and got[4].split()[2] == got[4].split()[5].removeprefix("J.")
    assert got[5] != texts[5] and got[5].isupper() and got[6] == texts[6] and got[7] != texts[7] and got[9] is None and got[10] == ""
    with pytest.raises(ValueError):
        pii.replace_personal(docs, "k", count="n")


def brute_surrogates(spark, rows, key):
    """The same rules one document at a time, for e-mail addresses and titled Latin names: values meet values."""
    import re

    new = {(r.doc_id, i): t for r in pii.replace_personal(spark.createDataFrame(rows, "doc_id long, text string"), key).collect() for i, t in enumerate(r.text.split())}
    old = {(d, i): t for d, x in rows for i, t in enumerate(x.split())}
    private = {w for t in old.values() if "@" in t for w in [t]} | {w for _, x in rows for m in re.findall(r"(?:Mr|Mrs|Dr)\. ((?:[A-Z][a-z]+ ?)+)", x) for w in m.split()}
    pairs = {(old[k], new[k]) for k in old}
    return private, pairs


def test_surrogates_are_a_one_to_one_map(spark):
    draw = random.Random(4)
    names = ["".join(draw.choice("abcdefghij") for _ in range(5)).title() for _ in range(60)]
    rows = [(i, f"see Mr. {draw.choice(names)} {draw.choice(names)} and Mrs. {draw.choice(names)} at {draw.choice(names).lower()}@x{draw.randrange(9)}.org now") for i in range(300)]
    private, pairs = brute_surrogates(spark, rows, "k")
    assert len(dict(pairs)) == len(pairs) == len({b for _, b in pairs})  # one surrogate a value, one value a surrogate
    assert all((a != b) == (a in private) for a, b in pairs)
    assert not {b for a, b in pairs if a in private} & private


def test_surrogates_differ_even_in_a_small_format(spark):
    values = [("ssn", f"{a:03d}-00-{b:04d}") for a in range(3) for b in range(800)]
    table = pii.surrogate_table(spark.createDataFrame(values, "kind string, value string"), "k").collect()
    new = {r.surrogate for r in table}
    assert len(new) == len(values) and not new & {v for _, v in values}


def test_toxicity_decodes_and_learns(spark):
    rows = [(i, f"some idiot number{i} here" if i % 4 == 0 else f"some clean number{i} here {'idioms' if i % 3 else ''}", int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    tests = ["some 1d10t here", "an i d i o t, they said", "1D!OT", "idiooooot", "i.d.i.o.t", "some clean text", None, ""]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).collect()}
    assert all(got[i] >= 0.3 for i in range(5)) and all(0 <= got[i] < 0.3 for i in range(5, 8)), got
    kept = toxicity.clean_documents(docs.selectExpr("doc_id", "text", "1 as _toxicity"), model)
    assert kept.columns == ["doc_id", "text", "_toxicity"] and kept.count() == 300


def test_toxicity_decodes_doubled_signs_and_split_words(spark):
    bad = ("idiot", "stupid", "moron", "ass")
    rows = [(i, f"some {bad[i // 4 % 4]} number{i} here" if i % 4 == 0 else f"some clean number{i} here, tomorrow as usual, sorry", int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    toxic = ["some stuupid here", "iidiot", "a mmorron", "455", "some @$$ here", "an a s s here", "a $ $", "some i d iot here", "stu pid", "s tupid, they said", "Mor ons of mor on", "1 d iot"]
    clean = ["some clean text", "sorry, tomorrow as usual", "as she said", "was so", "number 2024 here", "stu", "pid stu", "--- ...", "an", ""]
    got = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(toxic + clean)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert all(s >= 0.3 for s in got[: len(toxic)]) and all(s < 0.3 for s in got[len(toxic) :]), list(zip(toxic + clean, got))
    assert toxicity.score(spark.createDataFrame([(1, "stu"), (2, "pid")], "doc_id long, text string").coalesce(1), model).where("score >= 0.3").count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(docs, model).collect()] == [toxicity.FLOOR] * 2
    assert toxicity.score(docs.where("1 = 0"), model).count() == 0
