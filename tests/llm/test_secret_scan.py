import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import zlib
from urllib.parse import quote

import pytest
import zstandard

from flowsift.llm.secret_scan import masked, redact_secrets, scan, scan_secrets, secret_report

SECRET = "token = AbcdefGhijk12345"
PLAIN = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]
b64 = lambda data: base64.b64encode(data).decode()


def plain(text):
    found = [(m.start(), n, m.end(), kind) for n, (kind, pattern, good) in enumerate(PLAIN) for m in pattern.finditer(text or "") if good(m)]
    return [(kind, s, e) for s, _, e, kind in sorted(found)]


def check(docs):
    rows = secret_report(docs).collect()
    wanted = []
    for d in docs.collect():
        base = plain(d.text)
        counts = [sum(k == kind for k, _, _ in base) for kind, _, _ in PLAIN]
        wanted.append((d.doc_id, *counts, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()))
    order = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted((tuple(r[:5]) for r in rows), key=order) == sorted(wanted, key=order)
    return rows


def test_documents(documents):
    assert sum(r.n_assign + r.n_access + r.n_hex for r in check(documents)) > 0


def test_odd_documents(odd_documents):
    check(odd_documents)


def test_empty(empty_documents):
    assert secret_report(empty_documents).count() == 0


TRICKY = ["PASSWORD='aaaaaaaaaaaa' paſſword=aaaaaaaaaaaaa", "AKIA" + "A" * 13 + " AKIAAKIA" + "B" * 14, "0123456789abcdefABCDEF0123456789abcdef", "token token= :secret:=x", "apikey:" + "x" * 11 + " api_key=" + "x" * 12]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    assert [(k, s, e) for s, e, k in scan(text)[0]] == plain(text)


LAYERS = {
    "base64": b64(SECRET.encode()),
    "url-safe base64": base64.urlsafe_b64encode(("??>>" + SECRET).encode()).decode().rstrip("="),
    "url": "".join(f"%{b:02X}" for b in SECRET.encode()),
    "unicode": "".join(f"\\u{ord(c):04x}" for c in SECRET),
    "entities": "".join(f"&#{ord(c)};" for c in SECRET),
    "hexadecimal": SECRET.encode().hex().upper(),
    "gzip": b64(gzip.compress(SECRET.encode())),
    "zlib": b64(zlib.compress(SECRET.encode())),
    "bzip2": b64(bz2.compress(SECRET.encode())),
    "xz": b64(lzma.compress(SECRET.encode())),
    "zstd": b64(zstandard.compress(SECRET.encode())),
    "base64 three times": b64(b64(b64(SECRET.encode()).encode()).encode()),
    "url of base64 of gzip of base64": quote(b64(gzip.compress(b64(SECRET.encode()).encode())), safe=""),
    "url twice": quote(quote("x = y & " + SECRET, safe=""), safe=""),
}


@pytest.mark.parametrize("name", LAYERS)
def test_layers_are_unwrapped_and_mapped_back(name):
    wrapped = LAYERS[name]
    text = f"préface 😀 {wrapped} and the rest"
    start = text.index(wrapped)
    assign = [(s, e) for s, e, k in scan(text)[1] if k == "assign"]
    assert assign and all(start <= s < e <= start + len(wrapped) for s, e in assign)


def test_spans_are_tight_where_the_code_allows_it():
    text = "a%20b%20" + SECRET.replace(" ", "%20") + "%20c"
    spans = [s for s in scan(text)[1] if s[2] == "assign"]
    assert [text[s:e] for s, e, _ in spans] == [SECRET.replace(" ", "%20")]


def test_content_that_unwraps_to_itself_ends():
    assert scan("%2525252541 " * 50)[0] == []
    loop = b64(b"A" * 60)
    assert scan(loop * 3) is not None


def test_masking(spark, odd_documents):
    assert masked("abcdefg", [(0, 2, "hex"), (1, 3, "hex"), (5, 6, "hex")], "#") == "#de#g"
    docs = spark.createDataFrame([(1, "x " + SECRET + " y " + LAYERS["gzip"]), (2, None), (3, "")], "doc_id long, text string")
    assert [r.text for r in redact_secrets(docs).orderBy("doc_id").collect()] == ["x [secret] y [secret]", None, ""]
    assert redact_secrets(odd_documents).columns == odd_documents.columns
    assert dict(scan_secrets(odd_documents).dtypes)["spans"] == "string"


def wrapped_lines(digits, width, indent=""):
    return ("\n" + indent).join(digits[i : i + width] for i in range(0, len(digits), width))


def assigned(text, wrapped):
    start = text.index(wrapped)
    return [(s, e) for s, e, k in scan(text)[1] if k == "assign" and start <= s < e <= start + len(wrapped)]


@pytest.mark.parametrize("width", [16, 21, 64, 76])
@pytest.mark.parametrize("indent", ["", "    ", "> "])
@pytest.mark.parametrize("packed", [bytes, gzip.compress])
def test_wrapped_base64(width, indent, packed):
    for shift in range(0, 60, 7):
        content = (" ".join(f"w{i * i}" for i in range(shift)) + " " + SECRET + " tail").encode()
        wrapped = wrapped_lines(b64(packed(content)), width, indent)
        for text in (f"before\n{wrapped}\nafter it", f"-----BEGIN DATA-----\n{wrapped}\n-----END DATA-----\n", f'key: "{wrapped}"'):
            found = assigned(text, wrapped)
            assert found
            if packed is bytes and width == 64 and not indent:
                assert all(e - s <= 2 * len(SECRET) for s, e in found)


def test_url_safe_base64_of_compressed_content():
    for i in range(200):
        packed = base64.urlsafe_b64encode(zlib.compress(f"{i * i} {SECRET} {i}".encode())).decode()
        for wrapped in (packed, packed.rstrip("=")):
            assert assigned(f"x {wrapped} y", wrapped), wrapped


def test_glued_alphabets():
    for text in (f"name_{b64(SECRET.encode())}", f"a/b/{base64.urlsafe_b64encode(('??>>' + SECRET).encode()).decode()}"):
        assert any(k == "assign" for _, _, k in scan(text)[1])


def test_base64_wrapped_by_escaped_line_feeds():
    wrapped = "\\n".join(["", *wrapped_lines(b64(gzip.compress(f"{list(range(30))} {SECRET}".encode())), 64).split("\n"), ""])
    assert assigned(f'{{"key": "-----BEGIN-----{wrapped}-----END-----"}}', wrapped)
    assert assigned(f'{{"key": "x\\n{b64(SECRET.encode())}"}}', b64(SECRET.encode()))


SHELL = "powershell " + SECRET + " é"
ODD_BYTES = {
    "utf-16": SHELL.encode("utf-16"),
    "utf-16 little": SHELL.encode("utf-16-le"),
    "utf-16 big": SHELL.encode("utf-16-be"),
    "utf-32": SHELL.encode("utf-32"),
    "latin-1": ("caf\xe9 " + SECRET).encode("latin-1"),
    "form feed": ("one\f" + SECRET).encode(),
    "escape": ("\x1b[1m" + SECRET).encode(),
    "zero bytes": b"a\0" + SECRET.encode() + b"\0\0",
    "two gzip members": gzip.compress(b"one ") + gzip.compress(SECRET.encode()),
    "two bzip2 streams": bz2.compress(b"one ") + bz2.compress(SECRET.encode()),
    "two xz streams": lzma.compress(b"one ") + lzma.compress(SECRET.encode()),
    "two zstd frames": zstandard.compress(b"one ") + zstandard.compress(SECRET.encode()),
    "secret over two members": gzip.compress(SECRET[:12].encode()) + gzip.compress(SECRET[12:].encode()),
    "utf-16 in gzip": gzip.compress(SHELL.encode("utf-16")),
}


@pytest.mark.parametrize("name", ODD_BYTES)
@pytest.mark.parametrize("code", [b64, bytes.hex, lambda d: "".join(f"%{b:02x}" for b in d), lambda d: quote(d, safe="")])
def test_bytes_that_are_no_plain_text(name, code):
    wrapped = code(ODD_BYTES[name])
    assert assigned(f"x: {wrapped} y", wrapped)


def test_a_run_glued_to_a_stray_character():
    assert any(k == "assign" for _, _, k in scan(f"x {b64(SECRET.encode()).rstrip('=')}_ y")[1])


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, zstandard.compress, lambda d: lzma.compress(d, preset=0)])
def test_a_nested_run_over_the_border_of_a_window(pack):
    inner = b64(gzip.compress(random.Random(5).randbytes(30_000) + b" " + SECRET.encode()))
    wrapped = wrapped_lines(inner, 76)
    for run in (inner, wrapped):
        for before in (20_000, 35_000):
            content = b"word " * (((1 << 22) - before) // 5) + run.encode() + b" tail" * 10
            coded = b64(pack(content))
            assert assigned(f"x: {coded} y", coded)


def test_unpacked_content_is_held_a_window_at_a_time():
    import tracemalloc

    content = b"some quiet prose, line after line, with nothing to hide. " * 4600  # 256 kB
    packer = zlib.compressobj(9)
    packed = b"".join([*(packer.compress(content) for _ in range(80)), packer.compress(b" password=hunter2hunter2 "), packer.flush()])  # of 20 MB
    text = "x " + base64.b64encode(packed).decode() + " y"
    tracemalloc.start()
    base, every = scan(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not base and [(k, s, e) for s, e, k in every] == [("assign", 2, len(text) - 2)]
    assert peak < 60 << 20
