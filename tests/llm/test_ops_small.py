"""Every operator against a brute-force version on small hostile tables."""

import base64
import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

from quillchain.llm import bagminhash, contamination, files, flat, langid, media, mixing, sharding, shingles, site_style, suffix_dedup, url_filter, warc
from quillchain.llm.flat import SPACES

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]
DOC = "doc_id long, text string, lang string, source string, n_chars long, h string, node string, _row string, _n string, size string, shard_ string"


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, rows):
    """(doc_id, text, lang, source) rows with columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, 1, "x", "x", "x", "x", "x", "x") for r in rows], DOC)


def hostile_rows():
    long = prose(4000, 1)
    passage = prose(120, 2)
    near = prose(300, 3)
    rows = [(0, None, "en", "a"), (1, "", "en", None), (2, " \n\t ", None, "a"), (3, long, "en", "b"), (4, long, "en", "b"), (4, long, "en", "b"), (None, near, None, None), (6, near + " tail words here", "en", "a"), (7, near.replace(near.split()[0], "zzz", 1), "de", "c")]
    rows += [(10 + k, prose(60, 100 + k) + " " + passage + " " + prose(60, 200 + k), "en", "a") for k in range(6)]
    rows += [(30 + k, prose(25, 300), "en", "b") for k in range(15)]
    rows += [(60 + k, prose(5 + k, 400 + k), "de", "c") for k in range(20)]
    return rows


# --- op1


def test_arc_headers_of_both_versions():
    one = warc.arc_header(b"http://a/b c 1.2.3.4 20010203040506 text/html 12", warc.V1)
    assert one["URL"] == "http://a/b c" and one["Archive-length"] == "12"
    two = warc.arc_header(b"http://a/ 1.2.3.4 20010203 text/html 200 - - 77 f.arc 5", warc.V2)
    assert two["Result-code"] == "200" and two["Offset"] == "77"
    with pytest.raises(ValueError):
        warc.arc_header(b"no header", warc.V1)
    assert warc.arc_fields(warc.version_block(warc.V2)) == warc.V2
    with pytest.raises(ValueError):
        warc.arc_fields(b"3 0 x\n")
    assert warc.iso_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert warc.iso_date("2001") == "2001-01-01T00:00:00Z" and warc.iso_date("soon") == "1970-01-01T00:00:00Z"


@pytest.mark.parametrize("fields", [warc.V1, warc.V2])
@pytest.mark.parametrize("zipped", [True, False])
def test_arc_records_follow_declared_lengths(fields, zipped):
    contents = [warc.version_block(fields), b"HTTP/1.1 200 OK\r\nX-Page-Id: 5\r\n\r\nbody\nhttp://not/a header 1 2 3\n", b"", b"dns text\n" * 9]
    urls = ["filedesc://f.arc", "http://a/ b", "http://empty", "dns:a"]
    parts = [warc.arc_bytes(fields, u, "20010203040506", "text/dns" if u[:3] == "dns" else "text/plain", c, "f.arc") for u, c in zip(urls, contents)]
    data = b"".join(map(warc.gzipped, parts)) if zipped else b"".join(parts)
    got = list(warc.arc_records(io.BytesIO(data)))
    assert [r.content for r in got] == contents and [r.url for r in got] == urls
    assert [warc.warc_type(r)[0] for r in got] == ["warcinfo", "response", "resource", "resource"]
    again = next(warc.arc_records(io.BytesIO(data), got[1].offset, True, fields))
    assert again == got[1] and warc.record_id("f", again) == warc.record_id("f", got[1])
    out = b"".join(warc.gzipped(warc.converted("f.arc", r)) for r in got)
    back = list(warc.warc_records(io.BytesIO(out)))
    assert back[1].block == contents[1] and back[1].fields["warc-payload-digest"] == warc.sha1_of(b"body\nhttp://not/a header 1 2 3\n")
    with pytest.raises(ValueError):
        list(warc.arc_records(io.BytesIO(warc.gzipped(parts[0][:-30]) if zipped else data[: len(data) - 30])))


def test_pages_through_archives(spark):
    big = "<p>" + "é" * 700
    rows = [(1, "u 1", big), (7, None, big), (3, "", big), (3, "", big), (None, "n", big), (4, "u", None), (5, "u", ""), (6, "v", "y" * 999), (8, "v", "y" * 999), (9, "w", prose(30000, 5))]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload_digest string").repartition(3)
    got = warc.archived_pages(pages).collect()
    full = {(r[0], (r[2] or "").encode()) for r in rows}
    assert len(got) == len(rows) and {(r.page_id, r.payload_bytes, r.payload_digest) for r in got} == {(i, len(b), hashlib.sha1(b).hexdigest()) for i, b in full}
    size = len(big.encode())
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == size)
    assert kinds == {(7, "response", None): 1, (1, "revisit", 7): 1, (3, "revisit", 7): 2, (None, "revisit", 7): 1}
    assert all(r.record_type == "response" and r.refers_to is None for r in got if r.payload_bytes != size)
    assert warc.archived_pages(pages.limit(0)).collect() == []


# --- op2


def brute_repeats(texts, length=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_repeated_strings(spark, batches):
    shared = prose(200, 9)
    rows = hostile_rows() + [(200, "ab" * 500, "en", "a"), (201, shared[:401] + "é" + shared[:399] + "Q", "en", "a"), (202, "x" * 399, "en", "a"), (203, "x" * 400, "en", "a"), (204, prose(90, 10) + shared + prose(3, 11) + shared[5:900], "en", "a"), (205, "w" + shared[:400], "en", "a")]
    got = suffix_dedup.remove_repeats(table(spark, rows), batches=batches).collect()
    want = Counter((r[0], *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows]), strict=True))
    assert Counter(tuple(r)[:5] for r in got) == want
    assert all(len(r.text.encode()) == r.n_bytes - r.n_removed for r in got if "\ufffd" not in r.text)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quill_suffixes")]


def test_anchors_do_not_depend_on_the_length_of_the_chunk(spark):
    """Grams whose hashes differ in low bits only rank alike in a short and in a long text."""
    high, low = b"VaRHVb>^}$%i`X(p", b"yg2M:v6:!(7&YWPT"
    assert [int(flat.grams(np.frombuffer(g, np.uint8), 16)[0]) for g in (high, low)] == [0x5A5A5, 0x777]
    body = prose(200, 12)
    string = body[:50] + high.decode() + body[50:150] + low.decode() + body[150:368]
    longer = string + "Q" + prose(70_000, 13)[: (1 << 18) + 1000]  # more than a chunk: its own
    assert len(string) == 400
    texts = [string, longer]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(table(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])).collect()}
    assert got == dict(enumerate(brute_repeats(texts)))
    assert got[0][1] == got[1][1] == 400
    assert [suffix_dedup.anchors(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[3][0] for t in texts] == [50, 50]


def test_levels_are_scanned_and_merged_as_stored(spark):
    """Two levels meet without a shuffle or a sort, and merge in order."""
    family = suffix_dedup.SuffixFamily(spark)
    texts = [prose(200, k) for k in range(40)] + [prose(200, 3) + " " + prose(100, 7)]
    with family._sorted():
        made = spark.createDataFrame([(k % 2, (k, k), t) for k, t in enumerate(texts)], f"half int, node {suffix_dedup.NODE}, text string")
        one, two = (family._store(made.where(f"half = {h}").select("node", "text").mapInArrow(suffix_dedup._suffixes, suffix_dedup.SUFFIX).groupBy("s").agg(suffix_dedup.F.count("*").alias("times"))) for h in (0, 1))
        both, merged = family.scanned(one, two), family.merged(one, two)
        for df in (both, merged):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan, plan
        assert both.count() > 0
        level = family._store(merged)
        assert level.agg({"times": "sum"}).first()[0] == one.agg({"times": "sum"}).first()[0] + two.agg({"times": "sum"}).first()[0]
        family._drop(one, two, level)


def test_hashes_of_ranges():
    """Of equal bytes, wherever they stand; and not of the strings that fool a hash modulo 2**64."""
    raw = np.frombuffer(prose(300, 4).encode() * 2, np.uint8)
    half = len(raw) // 2
    start = np.arange(0, half - 60, 7)
    roll = flat.Rolling(raw)
    assert (roll.of(start, start + 50) == roll.of(start + half, start + half + 50)).all()
    assert len(np.unique(roll.of(start, start + 50))) == len(start)
    for x, y in (b"BM", b"6c", b"Xk"):
        word = [x]
        for _ in range(10):
            word += [x + y - c for c in word]
        other = [x + y - c for c in word]
        two = np.array(word + other, np.uint8)
        a, b = flat.Rolling(two).of(np.array([0, 1024]), np.array([1024, 2048]))
        assert a != b
        assert len(set(shingles.word_hashes(two, np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 2
    for x, y, p in ((3, 5, 2**61 - 1), (2**61 - 2, 2**61 - 2, 2**61 - 1), (123456789123456789, 987654321987654321, 2**61 - 1)):
        assert int(flat.mulmod(np.array([x], np.uint64), np.array([y], np.uint64))[0]) == x * y % p
    assert (flat.grams(raw, 11)[:100] == flat.grams(raw, 11)[half : half + 100]).all()


def test_repeated_strings_of_nothing(spark):
    assert suffix_dedup.remove_repeats(table(spark, hostile_rows()).limit(0)).collect() == []


# --- op3


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://A.Example.NET/en/x", ""), (2, "https://example.net/de", None), (3, "http://notexample.com/de/x", ""), (4, None, None), (5, "no scheme", link("http://z.net/")), (6, "http://q.com?x://y", ""), (7, "http://www.example.com/de/a?b#c", ""),
        (8, "http://copy.com/a", link("http://x.net/1")), (9, "http://copy.com/b", link("/a")), (10, "http://copy.com/c", link("b")), (11, "http://copy.com/c", ""),
        (12, "http://two.com/a", link("http://x.net/9")), (13, "http://two.com/b", link("http://two.com/a")), (14, "http://two.com/b", link("http://s.org/fr/1")),
        (15, "", ""), (16, "http://free.com/", "<meta http-equiv=refresh content='0; url=http://free.com/next'>"),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, node string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(pages).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("example.net", "/de", "net/", "block")
    assert got[3][2:] == (None, "allow") and got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow") and got[6] == ("q.com", "", None, "allow")
    assert got[7] == ("www.example.com", "/de/a", "example.com/de/", "block")
    assert [got[k][3] for k in (8, 9, 10, 11)] == ["block"] * 4  # through a canonical chain
    assert [got[k][3] for k in (12, 13, 14)] == ["allow"] * 3  # an explicit allow in the component wins
    assert url_filter.url_verdicts(pages.limit(0)).collect() == []


def test_redirects_at_size(spark):
    """A star of a million aliases, a chain of ten thousand, and a random graph against union-find."""
    star = spark.range(1_000_000).selectExpr("concat('http://star.test/', id) as src", "'http://a.net/hub' as dst")
    chain = spark.range(10_000).selectExpr("concat('http://chain.test/', id) as src", "concat('http://chain.test/', id + 1) as dst")
    end = spark.createDataFrame([("http://chain.test/10000", "http://x.org/fr/end"), ("http://chain.test/5", "http://b.net/")], "src string, dst string")
    rng = random.Random(12)
    random_edges = [(f"http://r.test/{rng.randrange(3000)}", f"http://r.test/{rng.randrange(3000)}") for _ in range(2200)] + [(f"http://r.test/{k}", "http://c.net/") for k in rng.sample(range(3000), 9)]
    edges = star.union(chain).union(end).union(spark.createDataFrame(random_edges, "src string, dst string"))
    asked = [(k, f"http://star.test/{k * 9973 % 1_000_000}") for k in range(50)] + [(100 + k, f"http://chain.test/{k * 97}") for k in range(100)] + [(1000 + k, f"http://r.test/{k}") for k in range(3000)]
    pages = spark.createDataFrame([(*a, None) for a in asked], "page_id long, url string, html string")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in random_edges:
        root[find(a)] = find(b)
    got = {r.page_id: r.verdict for r in url_filter.url_verdicts(pages, redirects=edges).collect()}
    assert all(got[k] == "block" for k, u in asked if "star" in u)
    assert all(got[k] == "allow" for k, u in asked if "chain" in u)  # an explicit allow before any block
    assert all((got[k] == "block") == (find(u) == find("http://c.net/")) for k, u in asked if "//r.test" in u)
    assert len({v for k, v in got.items() if k >= 1000}) == 2


# --- op4


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng.randint(1, 60), k), "en", rng.choice("ab")) for k in range(600)] + [(1000 + k, prose(9, k), "en", s) for k, s in enumerate([None, "c", "c", "d"])]
    rows += [(2000, None, "en", "a"), (2001, "  ", "en", "b"), (None, "one two", "en", "a"), (5, prose(3, 5), "en", "z\x0bz")]
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len([w for w in (r[1] or "").split()])) for r in rows)
    by = defaultdict(list)
    where = {(r[0], len((r[1] or "").split())): r[3] for r in rows}
    for r in got:
        by[where[r.doc_id, r.size]].append(r)
    total = sum(r.size for r in got)
    ranked = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    size = {s: sum(r.size for r in by[s]) for s in by}
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(ranked)}
    capped, target = set(), {}
    while True:  # reshare what exceeds three times a source
        left = total - sum(3 * size[s] for s in capped)
        free = [s for s in ranked if s not in capped]
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > 3 * size[s]]
        if not over:
            target = {s: 3 * size[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in ranked}
            break
        capped.update(over)
    for s in ranked:
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= max(r.size for r in by[s])
        assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in by[s])
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.where("h <> 'x'").isEmpty()
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.mix(docs.limit(0)).collect() == []


# --- op5


def test_png_round_trip_and_damage():
    for text in (b"", b"a" * 576, b"\x00" * 577, prose(3000, 1).encode()):
        payload = media.padded(text)
        assert len(payload) % 576 == 0 and len(payload) > 0 and media.from_png(media.to_png(payload)) == payload
    png = bytearray(media.to_png(media.padded(b"x")))
    png[45] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(png))


def test_media_columns(spark, tmp_path):
    rows = hostile_rows()
    got = media.media_features(table(spark, rows), folder=f"file://{tmp_path}/m").collect()
    want = []
    for r in rows:
        b = (r[1] or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        want.append((r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    assert len({r.payload_sha256 for r in got}) == len({(r.payload_sha256, r.media_bytes, r.media_sha256, r.feature) for r in got})
    many = media.read_media(spark, f"file://{tmp_path}/m", range_bytes=2000)  # ranges cut between members
    assert many.count() == len(rows) and many.select("archive", "offset").distinct().count() == len(rows) and many.where("error is not null").isEmpty()
    assert media.media_features(table(spark, rows).limit(0)).collect() == []


def test_members_are_retried_one_by_one(spark, tmp_path):
    rows = spark.createDataFrame([(str(k), prose(200, k)) for k in range(5)], "member string, payload string").coalesce(1)
    media.write_media(rows, f"file://{tmp_path}/m")
    (uri, _), = files.listed(f"file://{tmp_path}/m", ".zip")
    fails = Counter()

    class Flaky:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def read(self, n=-1):
            at = self.inner.tell()
            if n and 0 < at < 2000 and fails["left"] > 0:
                fails["left"] -= 1
                raise OSError("lost connection")
            return self.inner.read(n)

    archive = media.Archive(uri, lambda u: Flaky(open(u[7:], "rb")))
    entries = archive.entries(0, 1 << 40)
    fails["left"] = 2
    read = [archive.read(e) for e in entries]
    assert all(error is None for _, _, error in read) and max(t for _, t, _ in read) == 3 and [t for _, t, _ in read][-1] == 1
    path = uri[7:]
    raw = bytearray(open(path, "rb").read())
    raw[entries[2].offset + 80] ^= 255
    open(path, "wb").write(raw)
    bad = media.read_media(spark, f"file://{tmp_path}/m").collect()
    assert [r.member for r in bad if r.error] == ["2"] and sum(r.media is not None for r in bad) == 4


# --- op6


def parse(source):
    page = site_style.Page(source)
    page.judge()
    page.name_nodes()
    return page.content()


@pytest.mark.parametrize(
    "source, want",
    [
        ("<nav>n</nav><article><h1>T &amp;amp; &#8364;</h1><p>a <b>b</b>c\n d<br>e<p>f</article><footer>x</footer>", "T &amp; €\na bc d e\nf"),
        ('<div class="with-sidebar"><article>t<div id="comments"><p>c</div><aside>n</aside><p>u</article></div>', "t\nu"),
        ("<article>a<!-- x > y --><script>var t='</p>';</script><style>p{}</style> b</article>", "a b"),
        ("<main><header>H</header><ul><li>1<li>2</ul><table><tr><td>3<td>4</table><form>f</form></main>", "H\n1\n2\n3\n4"),
        ("<article>x<div class=ad>y</div>z</article>", "x\nz"),
        ("<article><p>cut <a href='x", "cut"),
        ("<section class=comments><article>no</article></section>", None),
        ("<article></article>", ""),
        ("plain", None),
    ],
)
def test_declared_content(source, want):
    assert parse(source) == want


def test_site_style_tree_cuts_templates(spark):
    rows = [(k, f"http://h.org/{k}", f"<body><div><p>Welcome to our site</p><ul><li><a href='/a'>Home</a></ul></div><div><p>Story {k} begins</p><p>and goes on {k * 7}</p></div><div>All rights</div></body>") for k in range(12)]
    rows += [(100, None, None), (101, "http://h.org/0", ""), (None, "http://one.org/", "<p>lonely &amp; one"), (0, "http://h.org/0", rows[0][2]), (102, "http://big.org", "<article>" + "<p>w</p>" * 5000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, row string")
    got = Counter((r.page_id, r.text, r.n_chars) for r in site_style.main_text(pages).collect())
    texts = [(k, f"Story {k} begins\nand goes on {k * 7}") for k in (*range(12), 0)] + [(100, ""), (101, ""), (None, "lonely & one"), (102, "\n".join(["w"] * 5000))]
    assert got == Counter((k, t, len(t)) for k, t in texts)
    assert site_style.main_text(pages.limit(0)).collect() == []


class Reader(HTMLParser):
    """The text inside <article>, event by event, by another parser and without a tree."""

    BLOCK = {"article", "h1", "h2", "p", "div", "ul", "li", "nav", "footer", "aside", "section", "table", "tr", "td"}
    SKIP = {"nav", "footer", "aside", "form", "script", "style"}

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.inside = self.skip = 0
        self.blocks = [""]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in self.SKIP
        if tag in self.BLOCK:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.skip -= tag in self.SKIP
        if tag in self.BLOCK:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(filter(None, (" ".join(b.split()) for b in self.blocks)))


def test_main_text_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: Reader(r.html or "").text() for r in pages.collect()}
    got = {r.page_id: r.text for r in site_style.main_text(pages).collect()}
    assert got == want and sum(map(bool, want.values())) > 200
    alone = {r.page_id: r.text for r in site_style.main_text(pages, declared=False).collect()}
    assert all(set(want[k].split("\n")) <= set(alone[k].split("\n")) for k in want)  # the tree cuts no content


# --- op7


def best_fit(sizes, capacity):
    """Bins by looking at every one for every item."""
    out, bins = [], []
    for s in sizes:
        fit = [(left, i) for i, left in enumerate(bins) if left >= s]
        left, i = min(fit) if fit else (capacity, len(bins))
        if i == len(bins):
            bins.append(capacity)
        bins[i] = left - s
        out.append(i)
    return out, bins


def test_best_fit_packing():
    rng = random.Random(1)
    for capacity, top in ((300, 100), (300, 12), (1000, 1000)):
        sizes = sorted((rng.randint(1, top) for _ in range(3000)), reverse=True)
        classes = sorted(Counter(sizes).items(), reverse=True)
        want, _ = best_fit(sizes, capacity)
        got = [b for parts in sharding.pack(classes, capacity) for b, n in parts for _ in range(n)]
        assert got == want
        load = Counter()
        for (size, n), parts in zip(classes, sharding.equal_shards(classes, 40), strict=True):
            assert sum(k for _, k in parts) == n
            for b, k in parts:
                load[b] += k * size
        assert len(load) == 40 and max(load.values()) - min(load.values()) <= top + 10
    assert sharding.pack([(301, 1)], 300) is None and sharding.pack([], 300) == [] and sharding.equal_shards([], 4) == []
    assert sharding.equal_shards([(1000, 2), (3, 5)], 3) == [[(0, 1), (1, 1)], [(2, 5)]]
    assert sharding.equal_shards([(9, 3)], 2) == [[(0, 2), (1, 1)]] and sharding.equal_shards([(20, 1), (9, 2)], 3) == [[(0, 1)], [(1, 1), (2, 1)]]


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANK_CHUNK", 7)
    rows = hostile_rows() + [(500 + k, prose(30 + k % 50, 900 + k), "en", "a") for k in range(800)] + [(2000 + k, f"same size {k:05d}", "en", "a") for k in range(600)]
    docs = table(spark, rows)
    got = sharding.shard_rows(docs).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"}
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(40)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32, r.size].add(r.shard)
    assert all(len(v) == 1 for v in where.values())
    # the loads are those of packing every group by itself, at the least capacity that works
    groups = Counter()
    for r in rows:
        groups[r[1] or ""] += len((r[1] or "").encode()) + 16
    sizes, load = sorted(groups.values(), reverse=True), Counter()
    for r in got:
        load[r.shard] += r.size
    alone = 0
    while sizes[alone] * (40 - alone) >= sum(sizes[alone:]):
        alone += 1
    capacity = max(load[b] for b in range(alone, 40))
    want, left = best_fit(sizes[alone:], capacity)
    assert len(left) <= 40 - alone
    slack = max(1, -(-sum(sizes[alone:]) // (40 - alone)) >> 16)
    assert len(best_fit(sizes[alone:], capacity - slack - 1)[1]) > 40 - alone or capacity - slack <= -(-sum(sizes[alone:]) // (40 - alone))
    assert sorted(load.values(), reverse=True)[:alone] == sizes[:alone] or alone == 0
    both = sharding.sharded(docs)
    assert both.columns == [*docs.columns, "shard"] and both.where("h <> 'x'").isEmpty() and both.count() == len(rows)
    assert sharding.sharded(both).columns == [*docs.columns, "shard", "shard_1"]
    assert sharding.shard_rows(docs.limit(0)).collect() == []


# --- op8


def test_language_of_held_out_texts(spark):
    parts = {"en": "the of and to in that with", "de": "der die und sch ung nicht ein", "fr": "le la les que des une dans"}
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(parts[x].split()) for _ in range(rng.randint(3, 40))), x, "s") for k in range(600) for x in [rng.choice(sorted(parts))]]
    rows += [(9000, None, "en", "s"), (9001, "123 !", "en", "s"), (9002, "", None, None), (None, "der die und", None, None), (9003, "the of and " * 4000, None, "s"), (9004, "Привет мир", None, "s")]
    docs = table(spark, rows)
    got = langid.identify(docs).collect()
    truth = {r[0]: r[2] for r in rows[:600]}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.99 * len(held)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (9000, 9001, 9002)] == ["und"] * 3 and by[9003].lang_pred == "en" and by[None].lang_pred == "de" and by[9004].lang_pred in parts
    assert langid.identify(docs.limit(0)).collect() == []
    unlabelled = spark.createDataFrame([(1, "the of", None)], "doc_id long, text string, lang string")
    assert langid.identify(unlabelled).first().lang_pred == "und"


def test_long_texts_and_many_languages():
    """A text is judged alike in slices of any size, and 70 languages take two mask words."""
    pa = langid.pa
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + k % 7)}xy" for k in range(70)]
    texts = pa.array([" ".join([w] * 40) for w in words])
    whole = [(h.tolist(), r.tolist()) for h, r in langid.gram_hashes(texts)]
    for limit in (7, 64, 1000):
        got = [(h.tolist(), r.tolist()) for h, r in langid.gram_hashes(texts, limit)]
        assert Counter(x for h, r in got for x in zip(h, r)) == Counter(x for h, r in whole for x in zip(h, r))
    slots = np.zeros((2, langid.SLOTS), np.uint64)
    for k in range(70):
        for h, _ in langid.gram_hashes(texts.slice(k, 1)):
            for at in langid._slots(h):
                slots[k // 64, at] |= np.uint64(1 << k % 64)
    model = langid.Model(tuple(f"l{k:02d}" for k in range(70)), slots, np.full(70, 0.001))
    said, score = langid.judge(texts, model)
    assert said.to_pylist() == list(model.languages) and (score > 0.99).all()
    said, score = langid.judge(pa.array([None, "", "12 !", "ß"]), model)
    assert said.to_pylist()[:3] == ["und"] * 3 and score[:3].tolist() == [0, 0, 0] and said.to_pylist()[3] != "und"
    assert langid.judge(pa.array([], pa.string()), model)[0].to_pylist() == []


# --- op9


def bag(text):
    raw = (text or "").encode()
    words = bytes(32 if SPACES[c] else c for c in raw).split()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def brute_classes(rows):
    """Least id by class of texts linked at 0.8 or more."""
    texts = sorted({r[1] for r in rows if r[1] is not None})
    bags, root = {t: bag(t) for t in texts}, {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            both, all_ = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if all_ and both / all_ >= 0.8:
                root[find(a)] = find(b)
    least = {}
    for r in rows:
        if r[1] is not None and r[0] is not None:
            c = find(r[1])
            least[c] = min(least.get(c, r[0]), r[0])
    return [least.get(find(r[1])) if r[1] is not None else r[0] for r in rows]


def near_rows():
    rows = hostile_rows()
    base = prose(200, 77).split()
    for k in range(60):  # a group of near copies, with chains below the threshold
        own = list(base)
        for j in range(k // 6):
            own[(j * 37 + k) % 200] = f"changed{k % 7}"
        rows.append((300 + k, " ".join(own), "en", "a"))
    rows += [(400, " ".join(["again"] * 50), "en", "a"), (401, " ".join(["again"] * 55), "en", "a"), (402, " ".join(["again"] * 90), "en", "a")]
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    got = bagminhash.near_duplicates(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter(zip([r[0] for r in rows], brute_classes(rows)))
    kept = bagminhash.one_of_each(table(spark, rows))
    assert kept.columns == table(spark, rows).columns and kept.where("node <> 'x'").isEmpty()
    want = {(c,) for r, c in zip(rows, brute_classes(rows)) if r[1] is not None}
    assert {(r.doc_id,) for r in kept.collect() if r.text is not None} == want and kept.where("text is null").count() == 1
    assert bagminhash.near_duplicates(table(spark, rows).limit(0)).collect() == []


def test_blocks_settle_what_stars_leave_open(spark):
    """Buckets of texts that share most registers of a band, yet are below 0.8, never halve."""
    base = prose(200, 78).split()
    rows = [(k, " ".join(w if (i * 7 + k * 13) % 199 > 4 else f"w{k}x{i}" for i, w in enumerate(base)), "en", "a") for k in range(40)]
    rows += [(100 + k, rows[k][1] + " tail", "en", "a") for k in range(0, 40, 3)]
    got = bagminhash.near_duplicates(table(spark, rows), block=3).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter(zip([r[0] for r in rows], brute_classes(rows)))
    names = [(k, (k, k), (k % 2, 0)) for k in range(8)]
    units = spark.createDataFrame([(n, list(range(20 + (k > 5))), bytes(80)) for k, n, _ in names], f"node {bagminhash.NODE}, units array<long>, sketch binary")
    open_ = spark.createDataFrame([(1, n, c) for _, n, c in names], f"key long, node {bagminhash.NODE}, comp {bagminhash.NODE}")
    found = bagminhash.block_links(open_, units, 3).collect()
    assert found and all(r.a.a % 2 != r.b.a % 2 and r.similarity >= 0.8 for r in found)


def test_bagminhash_estimates_weighted_jaccard():
    """Registers of weighted multisets agree as often as their overlap says, all in all."""
    off, rng = [], random.Random(9)
    for k in range(60):
        words = [f"{k}w{i}" for i in range(30)]
        x = [w for w in words for _ in range(rng.choice((0, 1, 1, 2, 5, 6, 11)))]
        y = [w for w in words for _ in range(rng.choice((0, 1, 1, 2, 5, 6, 11)))]
        one, two = Counter(x), Counter(y)
        want = sum((one & two).values()) / sum((one | two).values())
        code = {w: i for i, w in enumerate(words)}
        row = np.repeat([0, 1], [len(one), len(two)])
        sh = flat.mix(np.array([code[w] + 100 * k for c in (one, two) for w in c], np.uint64))
        times = np.array([n for c in (one, two) for n in c.values()])
        best = bagminhash.registers(row, sh, times, 2)
        off.append((best[0] == best[1]).mean() - want)
    assert abs(np.mean(off)) < 0.025 and np.std(off) < 0.09


def test_recall_at_small_scale_is_complete(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(docs).collect()}
    assert [got[r[0]] for r in rows] == brute_classes(rows)


# --- op10


def test_items_in_documents(spark):
    items = [(1, prose(40, 61)), (2, prose(12, 62)), (3, "just four words here"), (4, None), (5, ""), (6, prose(40, 61)), (None, prose(900, 63))]
    cut = prose(40, 61).split()
    rows = hostile_rows() + [(700, prose(9000, 64) + " " + prose(40, 61) + " " + prose(50, 65), "en", "a"), (701, " ".join(cut[:36]), "en", "a"), (702, " ".join(cut[:20]), "en", "a"), (703, "just four words here", "en", "a"), (704, "so just four words here", "en", "a"), (None, prose(12, 62), "en", "a"), (705, prose(900, 63), "en", "a"), (705, prose(900, 63), "en", "a")]
    docs = table(spark, rows)
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = Counter((r.doc_id, r.item_id, r.shingles, round(r.containment, 9)) for r in contamination.contaminated(docs, bench).collect())
    want = Counter()
    for r in rows:
        own = set(bag(r[1]))
        for i, t in items:
            s = set(bag(t))
            if s and len(s & own) >= 0.8 * len(s):
                want[r[0], i, len(s & own), round(len(s & own) / len(s), 9)] += 1
    assert got == want and want
    dirty = {r[0] for r in want}
    clean = contamination.clean_rows(docs, bench)
    assert clean.columns == docs.columns and Counter(r.doc_id for r in clean.collect()) == Counter(r[0] for r in rows if not (r[0] in dirty and set(bag(r[1])) & {s for _, t in items for s in bag(t)}))
    assert contamination.contaminated(docs, bench.limit(0)).collect() == [] and contamination.contaminated(docs.limit(0), bench).collect() == []


def test_warc_digest_is_base32():
    assert warc.sha1_of(b"") == "sha1:" + base64.b32encode(hashlib.sha1(b"").digest()).decode()
