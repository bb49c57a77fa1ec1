import hashlib
import random
import re

from lurewatch.llm import fill_middle
from lurewatch.llm.common import stored


def brute(i, text, seed=7, rate=100, spm=50):
    """(n, form, prefix code points, middle code points, output)."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in fill_middle.MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    out = [None, "", "\n", "\n\n\n", "one line", "x\n", "a <P> b\nc", "<", "<M", "é\nß\n\U0001f600" * 50,
           "no end " * 30_000, "\n" * 70_000, "ab\n" * 90_000 + "tail", "\U0001f600" * 40_000, "<S", "P>\n<"]
    for _ in range(250):
        out.append("".join(rng.choice("ab é\U0001f600\n\n<>PS ") for _ in range(rng.randrange(300))))
    return out


def test_frames_by_hand():
    for frame in (1, 3, 7, 64, 1 << 16):
        for i, text in enumerate(texts()):
            if len(text or "") > 5000 and frame < 64:
                continue
            n, form, prefix, middle, want = brute(i, text)
            kept = fill_middle.pack((text or "").encode(), frame)
            assert b"".join(fill_middle.stream(kept)) == (text or "").encode()
            a, b = sorted((i % (n + 1), (7 * i) % (n + 1)))
            for form in ("plain",) if form == "plain" else ("psm", "spm"):
                out, p, m = fill_middle.arrange(kept, form, a, b, frame=frame)
                again = b"".join(fill_middle.restore(out, form))
                assert again == (text or "").encode()
                if form != "plain":
                    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
                    assert (p, m) == (len("".join(lines[:a])), len("".join(lines[a:b])))


def test_only_cut_frames_are_read(monkeypatch):
    kept = fill_middle.pack(b"0123456\n" * 4096, 64)
    read = []
    whole = fill_middle._Cutter.part
    monkeypatch.setattr(fill_middle._Cutter, "part", lambda self, k: read.append(k) or whole(self, k))
    fill_middle.arrange(kept, "psm", 100, 3000, frame=64)
    assert len(set(read)) == 2


def test_brute_force(spark, table):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "a\nb\nc", "x"), (3, "\n\n\n", "y"),
                                                           (900, "q\nr\ns\n", "x"), (900, "q\nr\ns\n", "x")]
    df = table(rows, "doc_id long, text string, frames string")
    for seed, rate, spm, frame in ((7, 100, 50, 1 << 16), (8, 40, 20, 512)):
        kept = stored(fill_middle.store(df, frame=frame), "frames")
        got = fill_middle.digest(fill_middle.transform(kept, seed, rate, spm, frame=frame)).collect()
        want = []
        for i, t, _ in rows:
            n, form, prefix, middle, out = brute(i, t, seed, rate, spm)
            want.append((i, n, form, prefix, middle, hashlib.sha256(out.encode()).hexdigest(),
                         hashlib.sha256((t or "").encode()).hexdigest()))
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    none = fill_middle.store(df.where("false"))
    assert fill_middle.digest(fill_middle.transform(none)).count() == 0
