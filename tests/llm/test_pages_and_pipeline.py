import math
import random

import numpy as np
import pandas as pd
import pytest

from tandemframe.llm import byte_gru, packing, toxicity, wrappers
from tandemframe.llm.text_features import TermHasher

from .conftest import KINDS, made_rows

PAGE = "<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>{n}</a></li></ul></nav>{body}<footer>about {n}</footer></body></html>"


def texts(spark, pages):
    rows = [(i, u, h) for i, (u, h, _) in enumerate(pages)]
    got = {r.page_id: r for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got.values())
    return [got[i].text for i in range(len(pages))]


def test_main_text_of_several_layouts(spark):
    pages = []
    for k in range(8):  # an article with an optional note, malformed markup, a constant advert inside
        extra = "<aside>buy</aside>" if k % 2 else ""
        pages.append((f"http://a.example/{k}", PAGE.format(n=k, body=f"{extra}<article><h1>Title {k}</h1><p><b>One &amp; {k}<br>two<p>Three\n  {k}</p><div class=ad>Always the same</div></article><div class=comments><p>reader {k}</p></div>"), f"Title {k}\n\nOne & {k} two\n\nThree {k}"))
    for k in range(8):  # main, a form, a sidebar; lists and quotes are text
        pages.append((f"https://B.example:80/{k}?x", PAGE.format(n=k, body=f"<header><h2>Site</h2></header><main><h1>M {k}</h1><ul><li>p {k}</li><li>q</li></ul><form><p>mail</p></form><blockquote>said {k}</blockquote></main><div id=sidebar>side {k}</div>"), f"M {k}\n\np {k}\n\nq\n\nsaid {k}"))
    for k in range(8):  # no marked region: variable text with few links
        pages.append((f"http://c.example/{k}", PAGE.format(n=k, body=f"<div class=top>Welcome to us</div><div><p>Story {k} goes on.</p><p>And {k} ends.</p></div><div><a href=x>more {k}</a></div>"), f"Story {k} goes on.\n\nAnd {k} ends."))
    pages += [("http://alone.example/", PAGE.format(n=0, body="<article><p>Only page</p></article>"), "Only page"), (None, None, ""), ("http://a.example/", "", "")]
    got = texts(spark, pages)
    # 'q' is the same on all pages: it belongs to the repeated group, which varies
    assert got == [w for _, _, w in pages]


def test_copies_of_one_page_keep_their_text(spark):
    pages = [("http://d.example/x", PAGE.format(n=1, body="<article><h1>Same</h1><p>text</p></article>"), "Same\n\ntext")] * 9
    assert texts(spark, pages) == ["Same\n\ntext"] * 9


ARTICLE = "<h1>Title {k}</h1><p>Text {k} of the page.</p>"


@pytest.mark.parametrize("body", [
    '<body class="home no-sidebar"><article>{a}</article></body>',
    '<body class="single post-template sidebar"><main>{a}</main></body>',
    '<body><article class="post social-science">{a}</article></body>',
    '<body><main class="related footer">{a}</main></body>',
    '<body><div class="wp-block-group is-layout-constrained has-background zz sidebar-free theme-a main-content">{a}</div></body>',
    '<body><div class="sidebar-right"><div class="content">{a}</div></div></body>',
    '<body><form id="aspnetForm"><main>{a}</main></form></body>',
    '<body><script>for(i=0;i<n;i++){{f()}}</script><article>{a}</article></body>',
    '<body><SCRIPT>if(a<b)x="</div>"</SCRIPT ><style>a<b{{}}</style><article>{a}</article></body>',
    '<body><div class="zz yy xx wp-block-group is-layout has-background sidebar"><p>more {k}</p></div><article>{a}</article></body>',
    '<body><div class="comment-list"><p>reader {k}</p></div><div id="siteFooter">f {k}</div><div data-id="comments"><article>{a}</article></div></body>',
    '<body><div role="navigation">n {k}</div><div role="main">{a}</div></body>',
])
def test_class_names_lose_no_page(spark, body):
    """Words of a class count as a whole, never on the page, its main or its article."""
    pages = [(f"http://h.example/{k}", body.format(k=k, a=ARTICLE.format(k=k)), f"Title {k}\n\nText {k} of the page.") for k in range(3)]
    assert texts(spark, pages) == [w for _, _, w in pages]


def test_regions_are_those_of_the_page(spark):
    """One page with an article leaves the pages of its host that have none their text."""
    pages = [("http://e.example/a", "<body><article><p>An article.</p></article><div><p>beside it</p></div></body>", "An article.")]
    pages += [(f"http://e.example/{k}", f"<body><div><p>Story {k} here.</p><p>End {k}.</p></div></body>", f"Story {k} here.\n\nEnd {k}.") for k in range(6)]
    assert texts(spark, pages) == [w for _, _, w in pages]


def test_constant_text_of_a_content_region_stays_at_any_number_of_pages(spark):
    for n in (2, 4, 9):
        pages = [(f"http://g.example/{k}", f'<body><p class="cookie">Cookies</p><div class="content"><h2>Same</h2><p>Varies {k}.</p><p>x</p></div></body>', f"Same\n\nVaries {k}.\n\nx") for k in range(n)]
        assert texts(spark, pages) == [w for _, _, w in pages]


def test_deep_and_long_pages(spark):
    deep = "<div>" * 10_000 + "<p>deep</p>" + "</div>" * 10_000
    nav = "<div>" * 500 + "<nav><div>menu</div></nav><p>text</p>"
    long = "<article>" + "".join(f"<p>b{k}</p>" for k in range(100_000)) + "</article>"
    mixed = "".join(f"<{t}>m{k}</{t}>" for k, t in enumerate(["h2", "p", "ul", "pre", "p", "table", "dl"] * 3000) if k % 5)
    pages = [("http://deep.example/1", deep, "deep"), ("http://deep.example/2", nav, "text"), ("http://long.example/", long, "\n\n".join(f"b{k}" for k in range(100_000)))]
    pages += [(f"http://mixed.example/{i}", x, "\n\n".join(f"m{k}" for k in range(21_000) if k % 5 and (not i or k != 9))) for i, x in enumerate((mixed, mixed.replace("<pre>m9</pre>", "").replace("<p>m9</p>", "").replace("<ul>m9</ul>", "")))]
    got = texts(spark, pages)
    assert got[:3] == [w for _, _, w in pages[:3]]
    assert [len(g) for g in got[3:]] == [len(w) for _, _, w in pages[3:]]


def test_matches_are_common_subsequences():
    rng = random.Random(1)
    for size, most in ((8, None), (60, None), (60, 50)):
        was, wrappers.PAIRS = wrappers.PAIRS, most or wrappers.PAIRS
        try:
            for _ in range(40):
                a, b = ([rng.choice("abcdefgh" if size < 20 else [str(k) for k in range(40)]) for _ in range(rng.randrange(size))] for _ in range(2))
                got = wrappers.matches(a, b)
                assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
                if most is None:
                    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
                    for i, x in enumerate(a):
                        for j, y in enumerate(b):
                            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
                    assert len(got) == best[-1][-1]
        finally:
            wrappers.PAIRS = was


def test_wrappers_too_large_to_send_are_joined_by_salt(spark, monkeypatch):
    pages = [(f"http://s.example/{k}", PAGE.format(n=k, body=f"<article><p>Text {k}</p></article>"), f"Text {k}") for k in range(20)]
    monkeypatch.setattr(wrappers, "SENT_CHARS", 0)
    assert texts(spark, pages) == [w for _, _, w in pages]


def test_no_pages(spark):
    assert wrappers.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string, text string, host string")).count() == 0


def test_folding_makes_groups():
    tree, blocks = wrappers.parse("<dl><dt>a<dd>1<dt>b<dd>2<dt>c<dd>3</dl>")
    assert [b for b, _ in blocks] == ["a", "1", "b", "2", "c", "3"]
    assert wrappers.fold(tree).shape() == "(dl(*+(dt(#0t),dd(#0t))))"
    one, two = (wrappers.fold(wrappers.parse(x)[0]) for x in ("<div><h1>x</h1><p>y</p></div>", "<div><p>y</p><p>z</p><hr><table><tr><td>1</table></div>"))
    assert wrappers.merged([one, two]).shape() == "(div(h1?(#0t),p+(#0t),table?(tr(td(#0t)))))"


@pytest.fixture
def folder(spark, tmp_path):
    rows = [r for r in made_rows() if r[0] is not None]
    spark.createDataFrame(rows, KINDS).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline_against_brute_force(spark, folder):
    import corpus_pipeline as cp

    from .test_operators import linked, lower

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = docs
    for k, (name, stage) in enumerate(cp.STAGES[:4]):
        before = [(r.doc_id, r.text) for r in kept.collect()]
        out = stage(spark, kept, folder)
        assert out.columns == columns, name
        after = sorted((r.doc_id, r.text or "") for r in out.collect())
        if k == 1:
            assert all(any(map(str.isalpha, t)) for _, t in after)
        if k == 2:
            best = {}
            for i, t in before:
                best[lower(t)] = max(best.get(lower(t), -1), i)
            assert sorted((i, lower(t)) for t, i in best.items()) == sorted((i, lower(t)) for i, t in after)
            assert after == sorted({(i, t or "") for i, t in before if best[lower(t)] == i})
        if k == 3:
            want = linked(before)
            assert [i for i, _ in after] == sorted(i for i, (_, c) in want.items() if c == i)
        kept = spark.createDataFrame([tuple(r) for r in out.collect()], docs.schema)
    pieces = cp.STAGES[4][1](spark, kept, folder).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in kept.collect()}
    assert len(cp.run(spark, folder).collect()) == len(pieces)


CLASHING = KINDS.replace("digest string", "digest string, predicted int, lang_pred string, row int, id long, sha string, kept_id long, head long, `a.b` int")


def test_stages_leave_clashing_columns_alone(spark, folder):
    import corpus_pipeline as cp

    rows = [(*r[:9], 1, "xx", 5, 6, "s", 7, 8, 9, *r[9:]) for r in made_rows()]
    docs = spark.createDataFrame(rows, CLASHING)
    whole = {str(r) for r in docs.collect()}
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert {str(r) for r in out.collect()} <= whole and 0 < out.count()
    assert cp.STAGES[4][1](spark, docs, folder).count() >= len(rows)


def test_stages_of_empty_tables(spark, tmp_path, empty):
    import corpus_pipeline as cp

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in cp.STAGES[:4]:
        assert stage(spark, docs, str(tmp_path)).collect() == []
    assert cp.run(spark, str(tmp_path)).collect() == []


def plain_score(machine, ids):
    """The machine's score by adding up every pair."""
    raw = machine.b + sum(float(machine.w[i]) for i in ids)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            raw += sum(float(a) * float(b) for a, b in zip(machine.v[i], machine.v[j]))
    return 1 / (1 + math.exp(-raw))


def plain_language(net, text):
    """Languages' mean probabilities over the bytes of a text, step by step."""
    raw, h, total = text.encode(), net.u.shape[2], np.zeros(len(net.langs))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for start in range(0, len(raw), byte_gru.WINDOW):
        part = raw[start : start + byte_gru.WINDOW]
        padded = part + bytes(byte_gru.WINDOW - len(part))
        states = []
        for way, order in ((0, range(len(padded))), (1, range(len(padded) - 1, -1, -1))):
            state, seen = np.zeros(h), {}
            for k in order:
                a, s = net.x[way][:, padded[k]], net.u[way] @ state + net.c[way]
                r, z = sigmoid(a[:h] + s[:h]), sigmoid(a[h : 2 * h] + s[h : 2 * h])
                cand = np.tanh(a[2 * h :] + r * s[2 * h :])
                state = seen[k] = cand + z * (state - cand)
            states.append(seen)
        for k in range(len(part)):
            logits = net.o @ np.concatenate([states[0][k], states[1][k]]) + net.b
            e = np.exp(logits - logits.max())
            total += e / e.sum()
    return total / max(len(raw), 1)


def test_first_stages_against_plain_models(spark, tmp_path):
    import corpus_pipeline as cp

    rng = np.random.default_rng(6)
    stems = {"aa": "bako lami taru", "bb": "schlupf wrinz strock", "cc": "quiole deaux riette"}
    rows, marks = [], []
    for i in range(240):
        lang = ("aa", "bb", "cc")[i % 3]
        w = [str(rng.choice(stems[lang].split())) + "xyz"[int(rng.integers(0, 3))] for _ in range(int(rng.integers(3, 40)))]
        bad = i % 6 == 0
        rows.append((i, " ".join([*w, *(["vile"] if bad else [])]), lang, "s", 0))
        marks.append((i, 1, int(bad)))
    rows += [(900, "12 34", "aa", "s", 0), (901, None, "bb", "s", 0), (902, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    machine, hasher = toxicity.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))), TermHasher(toxicity.DIMS)
    plain = {r[0]: plain_score(machine, hasher(r[1]).tolist()) for r in rows}
    scored = {r.doc_id: r.score for r in toxicity.score_documents(docs, machine).collect()}
    assert machine.v.any() and all(scored[i] == pytest.approx(plain[i], rel=1e-4, abs=1e-6) for i in plain)
    out = [r.doc_id for r in cp.toxicity(spark, docs, str(tmp_path)).collect()]
    assert sorted(out) == sorted(i for i, x in plain.items() if x < 0.5) and 180 < len(out) < 240
    net = byte_gru.train(docs, per_language=60)
    best = {r[0]: plain_language(net, r[1]) for r in rows[:40]}
    got = {r.doc_id: r for r in byte_gru.predict(docs, net).collect()}
    for i, p in best.items():
        assert got[i].score == pytest.approx(p.max(), abs=1e-4) and got[i].lang_pred == net.langs[int(p.argmax())]
    full = byte_gru.train(docs)
    want = [i for i, t, *_ in rows if t and any(map(str.isalpha, t)) and plain_language(full, t).max() >= cp.LEAST_LANGUAGE_SCORE]
    assert sorted(r.doc_id for r in cp.language_id(spark, docs, str(tmp_path)).collect()) == want


def test_packing_stage_against_plain_best_fit(spark):
    """One shard: the bins are those of a best fit that looks at every open bin."""
    rng = np.random.default_rng(8)
    rows = [(i, "x" * int(rng.integers(0, 900))) for i in range(150)] + [(3, "x" * 10), (3, "x" * 10), (None, "abc"), (7, None)]
    capacities = (64, 128, 200)
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), capacities=capacities).toPandas()
    pieces = []
    for i, t in rows:
        n = math.ceil(len((t or "").encode()) / 4)
        pieces += [(i, k, min(200, n - 200 * k)) for k in range(math.ceil(n / 200))]
    pieces.sort(key=lambda p: (p[0] is not None, p[0] or 0, p[1], p[2]))
    todo = sorted(range(len(pieces)), key=lambda k: (-pieces[k][2], k))
    bins, where = [], {}
    for at, k in enumerate(todo):
        n = pieces[k][2]
        fitting = [b for b in bins if b["cap"] - b["used"] >= n]
        if fitting:
            # the least room; of bins with that room the one that came to it last
            b = min(fitting, key=lambda b: (b["cap"] - b["used"], -b["at"]))
        else:
            def filled(room):
                total = 0
                for later in sorted((pieces[j][2] for j in todo[at + 1 :]), reverse=True):
                    if later <= room:
                        total, room = total + later, room - later
                return total

            cap = min((c for c in capacities if c >= n), key=lambda c: (packing.cost(c) / (n + filled(c - n)), -c))
            b = {"cap": cap, "used": 0, "held": [], "at": 0}
            bins.append(b)
        b["held"].append(pieces[k])
        b["used"] += n
        b["at"] = at + 1
    want = sorted((tuple(sorted((str(i), p, n) for i, p, n in b["held"])), min(c for c in capacities if c >= b["used"])) for b in bins)
    binned = got.dropna(subset=["bin_id"])
    made = sorted((tuple(sorted((str(None if pd.isna(r.doc_id) else int(r.doc_id)), int(r.piece), int(r.n_tokens)) for r in b.itertuples())), int(b.bin_capacity.iloc[0])) for _, b in binned.groupby("bin_id"))
    assert made == want
    assert len(got) - len(binned) == sum(not t for _, t in rows)


def test_registered_names():
    from tandemframe.llm import registry

    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
