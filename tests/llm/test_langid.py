"""Language evidence on literal pages and against held-out declarations."""

import math
import re

import numpy as np
import pytest

EN, DE = "the house and the garden were there with them this thing that other", "das haus und der garten waren dort nicht mit ihnen dieser schöne sich eine"


@pytest.fixture(scope="module")
def speech(spark):
    return spark.createDataFrame([(1, EN, "en"), (2, DE, "de"), (3, EN + " through", "EN "), (4, None, "de"), (5, "zzz", None)], "doc_id long, text string, lang string")


def page(text, lang=None):
    said = f' lang="{lang}"' if lang else ""
    return f"<!DOCTYPE html><html{said}><head><title>x</title></head><body><nav>{DE * 3}</nav><article><p>{text} &amp; 17</p></article><footer>{DE}</footer></body></html>"


def test_evidence(spark, speech):
    from timbra.llm.langid import identified

    rows = [(k, f"https://u@a.site.de:80/{k}", page(DE)) for k in range(30)] + [(100 + k, f"http://b.site.com/{k}", page(EN, "en-GB")) for k in range(30)]
    rows += [(900, "https://a.site.de/x", page("")), (901, "http://b.site.com/y", page("")), (902, None, None), (903, "https://c.other.net/", page("", "DE")), (904, "https://a.site.de/q", page(EN + EN, "en")), (905, "not a url", ""), (905, "not a url", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("none", "none")
    got = [r.asDict() for r in identified(pages, speech).collect()]
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert all(by[k]["lang"] == "de" for k in range(30)) and all(by[100 + k]["lang"] == "en" for k in range(30))
    assert by[900]["lang"] == "de" and by[901]["lang"] == "en"  # host and suffix alone
    assert by[903]["lang"] == "de" and by[904]["lang"] == "en"  # declaration; text over host
    assert by[0]["host"] == "a.site.de" and by[0]["suffix"] == "de" and by[100]["declared"] == "en" and by[902]["declared"] is None
    assert all(0.5 <= r["probability"] <= 1 for r in got)
    assert identified(pages.limit(0), speech).count() == 0
    none = identified(pages, speech.limit(0)).collect()
    assert len(none) == len(rows) and all(r.lang is None for r in none)


def test_text_model_counts_all(speech):
    from timbra.llm.langid import ALPHA, BUCKETS, languages, text_model, triples

    assert languages(speech) == ["de", "en"]
    table = text_model(speech, ["de", "en"])
    for k, texts in enumerate([[DE, ""], [EN, EN + " through"]]):
        want = np.full(BUCKETS, ALPHA)
        for t in texts:
            np.add.at(want, triples(t.encode()), 1)
        assert np.allclose(table[:, k], np.log(want / want.sum()))


def fused(pages, names, table):
    """Plain fusion of (page_id, url, html) rows, with dictionaries."""
    from collections import Counter
    from urllib.parse import urlsplit

    from timbra.llm import langid as L

    n, rows = len(names), []
    for i, url, html in pages:
        g = L.triples(L.main_text((html or "").encode()))
        ll = table[g].sum(0) / L.OVERLAP
        host = (urlsplit(url).hostname or "") if url and "://" in url else ""
        m = re.search(L.DECLARED, html or "")
        said = m[1].lower() if m else None
        rows.append((i, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], n + 1 if said is None else names.index(said) if said in names else n, ll, int(ll.argmax()) if len(g) else None))
    by = {name: Counter((r[c], r[6]) for r in rows if r[6] is not None) for name, c in (("h", 1), ("d", 2), ("s", 3), ("a", 4))}
    size = {name: Counter(r[c] for r in rows if r[6] is not None) for name, c in (("h", 1), ("d", 2), ("s", 3), ("a", 4))}
    whole = Counter(r[6] for r in rows if r[6] is not None)
    total = sum(whole.values())
    out = {}
    for i, host, domain, suffix, said, ll, guess in rows:
        scores = []
        for k in range(n):
            own, mine = float(guess == k), float(guess is not None)
            top = (whole[k] + 1) / (total + n)
            d = (by["d"][domain, k] - own + L.GLOBAL_WEIGHT * top) / (size["d"][domain] - mine + L.GLOBAL_WEIGHT)
            h = (by["h"][host, k] - own + L.DOMAIN_WEIGHT * d) / (size["h"][host] - mine + L.DOMAIN_WEIGHT)
            s = math.log((by["s"][suffix, k] - own + L.SUFFIX_PRIOR * size["s"][suffix] / total) / (whole[k] + L.SUFFIX_PRIOR)) if size["s"][suffix] else 0.0
            a = 0.0 if said == n + 1 else math.log((by["a"][said, k] + (said == k) * L.DECLARED_PRIOR + L.DECLARED_FLOOR) / (whole[k] + L.DECLARED_PRIOR + L.DECLARED_FLOOR * (n + 2)))
            scores.append(ll[k] + a + s + math.log(h))
        most = max(scores)
        out[i] = (names[scores.index(most)], 1 / sum(math.exp(x - most) for x in scores))
    return out


def conflicts(spark, n=240):
    """Pages whose text, declaration, host and suffix disagree in every way, with the language
    of their text: from documents that no model is learned from here."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null and length(text) > 400")
    rows = docs.select("doc_id", "lang", "text").orderBy("doc_id").limit(n).collect()
    langs = sorted({r.lang for r in rows})
    pages = []
    for k, r in enumerate(rows):
        other = langs[(langs.index(r.lang) + 1 + k % (len(langs) - 1)) % len(langs)]
        kind = ("agree", "wrong declaration", "foreign host", "few words", "no text")[k % 5]
        said = other if kind == "wrong declaration" else None if kind == "no text" else r.lang
        host = f"www.site{k % 3}.{other if kind == 'foreign host' else r.lang}"
        text = {"few words": " ".join(r.text.split()[:3]), "no text": ""}.get(kind, r.text[:600])
        pages.append((k, f"https://{host}/{k}", f"<html{f' lang={said}' if said else ''}><body><p>{text}</p>", r.lang, kind))
    return rows, pages


def test_fusion_is_the_plain_sum(spark, monkeypatch):
    """Against dictionaries, on conflicting evidence, with one block of languages and several."""
    from timbra.llm import langid

    rows, pages = conflicts(spark)
    held = {r.doc_id for r in rows}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(~langid.F.col("doc_id").isin(held))
    frame = spark.createDataFrame([p[:3] + ("x", "y") for p in pages] + [(900, None, None, "x", "y"), (901, "no url", "<p>" + "das ist " * 300_000, "x", "y")], "page_id long, url string, html string, guess string, host string")
    names = langid.languages(docs)
    want = fused([tuple(r)[:3] for r in frame.collect()], names, langid.text_model(docs, names))
    for block in (64, 2):
        monkeypatch.setattr(langid, "LANGUAGE_BLOCK", block)
        got = {r.page_id: r for r in langid.identified(frame, docs).collect()}
        assert len(got) == len(pages) + 2
        for i, (lang, p) in want.items():
            assert got[i].lang == lang and got[i].probability == pytest.approx(p, rel=1e-6)
    right = {}
    for i, _, _, lang, kind in pages:
        right.setdefault(kind, []).append(got[i].lang == lang)
    rates = {k: float(np.mean(v)) for k, v in right.items()}
    print("accuracy by kind of conflict:", rates)
    assert min(rates["agree"], rates["wrong declaration"], rates["foreign host"]) > 0.95 and rates["few words"] > 0.9 and rates["no text"] > 0.9


def test_any_number_of_languages(spark, monkeypatch):
    from timbra.llm import langid

    say = lambda k: f"q{chr(97 + k % 26)}{chr(97 + k // 26)}z " * 20
    docs = spark.createDataFrame([(k, say(k), f"l{k:04d}") for k in range(300)], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.org/", f"<p>{say(k)}") for k in range(0, 300, 9)], "page_id long, url string, html string")
    assert all(r.lang == f"l{r.page_id:04d}" for r in langid.identified(pages, docs).collect())


def test_main_text():
    from timbra.llm.langid import main_text

    assert main_text(page("Hello").encode()).split() == [b"x", b"Hello", b"17"]
    assert main_text(b"<body><script>var a</script>plain <b>text</b><footer>f</footer>").split() == [b"plain", b"text"]
    assert main_text(b"").strip() == b""


def test_agrees_with_declarations(spark):
    from timbra.llm.langid import identified

    sf = "/root/testdata/sf0.01"
    got = identified(spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert np.mean([r.lang == r.declared for r in got]) > 0.98 and all(math.isfinite(r.probability) for r in got)
