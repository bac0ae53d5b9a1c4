"""Cases of which the operators once did less than the whole."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathomer.llm import decontaminate, html_text, licenses, secrets, warc
from fathomer.workspace import new_path
from tests.llm.test_free import OPENSSH, PKCS8, RSA, b64, tlv


def table(spark, docs, schema="doc_id long, text string"):
    return spark.createDataFrame(docs, schema)


# -- archives ----------------------------------------------------------------------------------


@pytest.mark.parametrize("split", ["128m", "900b"])
def test_archives_hold_pages_whose_address_holds_the_magic(spark, split):
    urls = ["http://x/1", "http://x/WARC/1.1/spec", "WARC/1.0", "http://x/WARC/1.1", "http://x/WARC/1.WARC/1.1?WARC/1.1", "http://x/6"]
    html = ["a" * 500, "\nWARC/1.1\r\n\r\nx", "WARC/1.", None, "\r\n\r\nWARC/1.1\r\n", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = new_path(spark, "t")
        warc.write_archives(table(spark, list(zip(range(6), urls, html, strict=True)), "page_id long, url string, html string").coalesce(1), path)
        got = sorted((r.record_id, r.target, r.payload_digest) for r in warc.read_archives(spark, path).collect())
        digest = lambda p: base64.b32encode(hashlib.sha1((p or "").encode()).digest()).decode()
        assert got == [(f"<urn:page:{i}>", urls[i], digest(html[i])) for i in range(6)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# -- decontamination ---------------------------------------------------------------------------


def similarity(window: str, item: str) -> float:
    a, b = (Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (window.split(), item.split()))
    return (a & b).total() / (a | b).total()


@pytest.mark.parametrize("missing", [1, 5, 9, 10])
def test_documents_shorter_than_an_item_are_compared_whole(missing):
    words = [f"w{i}" for i in range(50)]
    index = decontaminate.Index([(7, " ".join(words))])
    for part in (words[:-missing], words[missing:]):
        want = similarity(" ".join(part), " ".join(words))
        found = index.matches(" ".join(part))
        assert found == ([(7, pytest.approx(want), 0, 50 - missing)] if want >= 0.8 else [])


def edited(words: list[str], *places: int) -> str:
    return " ".join("edit" + str(i) if i in places else w for i, w in enumerate(words))


@pytest.mark.parametrize("listings", [1, 2, 10])
@pytest.mark.parametrize(("size", "places"), [(50, (25,)), (104, (20, 80)), (204, (50, 120))])
def test_edited_passages_of_repeated_items_are_found(listings, size, places):
    words = [f"s{size}w{i}" for i in range(size)]
    item, passage = " ".join(words), edited(words, *places)
    index = decontaminate.Index([(k, item.upper() if k % 2 else item) for k in range(listings)])
    assert index.matches(f"before it {passage} after it") == [(k, pytest.approx(similarity(passage, item)), 2, size) for k in range(listings)]


def test_edited_passages_of_items_of_one_template_are_found(spark):
    template = [f"t{i}" for i in range(60)]
    items = [(k, " ".join([*template, *(f"own{k}x{i}" for i in range(8))])) for k in range(12)]
    passage = edited(items[3][1].split(), 2, 66)
    assert similarity(passage, items[3][1]) >= 0.8
    for block in (20_000, 5):
        found = decontaminate.find_matches(table(spark, [(1, passage)]), table(spark, items + items, "item_id long, text string").distinct(), block=block)
        assert 3 in {r.item_id for r in found.collect()}


def test_uneven_weights_keep_fingerprints_within_the_radius():
    template = [f"t{i}" for i in range(100)]
    items = [" ".join([*template, *(f"own{k}x{i}" for i in range(6))]) for k in range(10)]
    own = decontaminate.Index(list(enumerate(items)))
    lost = 0
    for k in range(10):
        for at in range(0, 90, 3):
            lost += k not in {m[0] for m in own.matches(edited(items[k].split(), at))}
    assert lost == 0


# -- HTML --------------------------------------------------------------------------------------

PROSE = "The quick fox of the house was in it and that is what they had to say about the matter at hand today. " * 3
ADVERT = "Super mega winter sale! Brand new phones, cheap tablets, free shipping worldwide, limited stock, order now!"
FOREIGN = "Съешь же ещё этих мягких французских булок, да выпей чаю, говорил старый мастер своему ученику вечером."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div>{PROSE}</div><article class=card><a href=x>Other story</a></article><section>{PROSE}</section>", f"{PROSE.strip()} {PROSE.strip()}"),
        (f"<div>{PROSE}</div><article><p>{PROSE}</p><p>End.</p></article><div>{ADVERT}</div>", f"{PROSE.strip()} {PROSE.strip()} End."),
        (f"<article><p>{PROSE}</p><p>{PROSE[:100]}<a href=x>{PROSE[:90]}</a></p></article>", PROSE.strip()),
        (f"<div>{FOREIGN}</div><article><p>{FOREIGN}</p></article>", FOREIGN),
    ],
)
def test_articles_are_evidence_and_no_filter(page, text):
    assert html_text.main_text(page) == text


# -- licenses ----------------------------------------------------------------------------------


def test_every_notice_is_known(spark):
    notices = [(key, f"{opening} {name}.") for key, names in licenses.NAMES for name in names for opening in licenses.OPENINGS]
    out = {r.doc_id: (r.notices, r.n_notices) for r in licenses.scan(table(spark, [(i, f"prose\n{text}\nmore") for i, (_, text) in enumerate(notices)])).collect()}
    assert out == {i: (key, 1) for i, (key, _) in enumerate(notices)}


def test_texts_of_a_callers_table_need_no_hint(spark):
    known = spark.createDataFrame([("do what you want",)], "text string").select(licenses.digest(F.col("text")).alias("digest"), F.lit("X").alias("license"))
    out = licenses.scan(table(spark, [(1, "Do what you want!"), (2, "prose\n\nDo what you want."), (3, None)]), known=known).collect()
    assert sorted((r.doc_id, r.license, r.notices) for r in out) == [(1, "X", "X"), (2, None, "X"), (3, None, "")]


# -- secrets -----------------------------------------------------------------------------------


#: Of a multiple of three bytes.
EVEN = tlv(0x30, tlv(2, b"\1") + tlv(4, bytes(range(32))) + tlv(0xA0, bytes([6, 3, 42, 134, 72])))
EVEN = EVEN if len(EVEN) % 3 == 0 else tlv(0x30, tlv(2, b"\1") + tlv(4, bytes(range(32))) + tlv(0xA0, bytes([6, 3 + -len(EVEN) % 3, *range(1, 4 + -len(EVEN) % 3)])))


def wrapped(text: str, width: int, end: str = "\n") -> str:
    return end.join(text[i : i + width] for i in range(0, len(text), width))


def armoured(data: bytes, width: int = 64) -> str:
    return f"-----BEGIN PRIVATE KEY-----\n{wrapped(b64(data), width)}\n-----END PRIVATE KEY-----\n"


@pytest.mark.parametrize(
    ("before", "key", "after", "kind"),
    [
        ("key\n", wrapped(b64(PKCS8), 64), "\nafter", "der"),
        ("a long line of words\n", wrapped(b64(RSA), 76, "\r\n"), "\r\n\r\nafter", "der"),
        ("key: |\n    ", wrapped(b64(PKCS8), 64, "\n    "), "\n", "der"),
        ("", wrapped(b64(OPENSSH), 70), "\nword", "ssh"),
        ("", wrapped(PKCS8.hex(), 60), "\n\n", "der"),
        ("tls.key: ", b64(armoured(PKCS8).encode()), "\n", "pem"),
        ("tls.key:\n", wrapped(b64(armoured(RSA).encode()), 76), "\n", "pem"),
    ],
)
def test_wrapped_and_encoded_keys_are_found(before, key, after, kind):
    spans = [s for s in secrets.find_secrets(before + key + after)[1] if s[2] not in secrets.BASE_KINDS]
    assert spans == [(len(before), len(before) + len(key), kind)]


def boxed(label: str, body: str, head: str = "") -> str:
    return f"-----BEGIN {label}-----\n{head}{body}\n-----END {label}-----"


HEAD = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
SEALED = tlv(0x30, tlv(0x30, tlv(6, b"\x2a\x86\x48") + tlv(0x30, b"")) + tlv(4, bytes(range(48))))


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (boxed("RSA PRIVATE KEY", wrapped(b64(bytes(range(64))), 64), HEAD), True),
        (boxed("RSA PRIVATE KEY", wrapped(b64(bytes(range(64))), 64), HEAD).replace("\n", "\\n"), True),
        (boxed("RSA PRIVATE KEY", wrapped(b64(bytes(range(60))), 64), HEAD), False),
        (boxed("RSA PRIVATE KEY", wrapped(b64(bytes(range(64))), 64), HEAD.replace("AES", "DES")), False),
        (boxed("RSA PRIVATE KEY", wrapped(b64(bytes(range(64))), 64)), False),
        (boxed("RSA PRIVATE KEY", wrapped(b64(RSA), 64), "Comment: mine\n"), True),
        (boxed("ENCRYPTED PRIVATE KEY", wrapped(b64(SEALED), 64)), True),
        (boxed("ENCRYPTED PRIVATE KEY", wrapped(b64(SEALED[:-1]), 64)), False),
        (boxed("PUBLIC KEY", wrapped(b64(RSA), 64)), False),
    ],
)
def test_sealed_keys_are_found_by_their_structure(text, found):
    assert [s for s in secrets.find_secrets(text)[1] if s[2] == "pem"] == ([(0, len(text), "pem")] if found else [])


def test_nested_lengths_are_followed_at_any_depth():
    inner = b""
    for _ in range(3000):
        n = len(inner)
        inner = (b"\x30" + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2, "big"))) + inner
    key = tlv(0x30, tlv(2, b"\1") + tlv(4, bytes(32)) + tlv(0xA0, inner))
    assert secrets.is_der_key(key) and not secrets.is_der_key(key.replace(b"\x30\x00", b"\x30\x01"))


def test_lines_that_do_not_parse_are_no_keys():
    for text in (wrapped(b64(PKCS8)[4:], 64), wrapped(b64(armoured(bytes(90)).encode()), 76), "\n".join(["x" * 64] * 2000)):
        assert [s for s in secrets.find_secrets(text)[1] if s[2] not in secrets.BASE_KINDS] == []


def test_armour_of_short_lines_is_found_in_a_text_without_other_signs():
    text = "-----BEGIN PRIVATE KEY-----\n" + wrapped(b64(EVEN), 32) + "\n-----END PRIVATE KEY-----"
    assert "=" not in text and ":" not in text
    assert secrets.find_secrets(text)[1] == [(0, len(text), "pem")]


def test_whole_licences_are_known_in_any_wrapping(spark):
    import textwrap
    from pathlib import Path

    folder = Path(licenses.__file__).parent / "licence_texts"
    docs, want = [], {}
    for path in sorted(folder.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        paragraphs = text.split("\n\n")
        notice = lambda p: "opyright (" in p or "opyright [" in p
        for width in (50, 100):
            anew = "\n\n".join(p if notice(p) else textwrap.fill(p, width) for p in paragraphs)
            for variant in (text, anew, anew.upper(), text.replace("\n", "\r\n")):
                docs.append((len(docs), variant))
                want[len(docs) - 1] = path.stem
        docs.append((len(docs), text[:-300]))
        want[len(docs) - 1] = None
    docs.append((len(docs), "Copyright The Example Authors\n\n" + licenses._MIT))
    want[len(docs) - 1] = "MIT"
    out = {r.doc_id: r.license for r in licenses.scan(table(spark, docs)).collect()}
    wrong = {k: (out[k], want[k]) for k in want if out[k] != want[k] and want[k]}
    assert not wrong
    assert sum(out[k] is None for k, v in want.items() if v is None) >= 7
