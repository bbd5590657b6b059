from struct import pack

import pytest

from tabguard.errors import IngestError, TableError
from tabguard.plans.chat import Chat
from tabguard.plans.planner import PlannerError, json_call
from tabguard.sources import files, xls
from tabguard.streaming import quality_stream
from tabguard.workspace import Jobs, operations


def record(kind, data=b""):
    return pack("<HH", kind, len(data)) + data


def text(s, length="<H"):
    wide = any(ord(c) > 255 for c in s)
    return pack(length, len(s)) + bytes([wide]) + s.encode("utf-16-le" if wide else "latin-1")


def old_workbook(texts, cells, small=False):
    """A workbook of two sheets, written by hand; the last text goes over to a second record."""
    body = b"".join(map(text, texts[:-1]))
    last = texts[-1].encode("utf-16-le")
    body += pack("<HB", len(texts[-1]), 1) + last[:10]
    rest = bytes([1]) + last[10:]
    shared = record(0xFC, pack("<II", len(texts), len(texts)) + body) + record(0x3C, rest)
    head = record(0x809, pack("<HHHHII", 0x600, 5, 0, 0, 0, 0)) + record(0x41E, pack("<H", 164) + text("yyyy-mm-dd hh:mm"))
    head += b"".join(record(0xE0, pack("<HH", 0, f) + b"\0" * 16) for f in (0, 14, 164))
    names = ["Erstes", "Zwei €"]
    size = len(head) + sum(len(record(0x85, b"\0" * 6 + text(n, "<B"))) for n in names) + len(shared) + 4
    first = record(0x809, pack("<HHHHII", 0x600, 16, 0, 0, 0, 0)) + cells + record(0x0A)
    second = record(0x809, pack("<HHHHII", 0x600, 16, 0, 0, 0, 0)) + record(0x204, pack("<HHH", 0, 0, 0) + text("only")) + record(0x203, pack("<HHHd", 1, 0, 0, 2.5)) + record(0x0A)
    at = [size, size + len(first)]
    sheets = b"".join(record(0x85, pack("<IBB", a, 0, 0) + text(n, "<B")) for a, n in zip(at, names))
    book = head + sheets + shared + record(0x0A) + first + second
    if not small:
        book += b"\0" * max(0, 4096 - len(book))
    entry = lambda name, kind, start, size: (name.encode("utf-16-le") + b"\0" * 64)[:64] + pack("<HB", 2 * len(name) + 2, kind) + b"\0" * 49 + pack("<II", start, size) + b"\0" * 4
    pad = lambda b, n: b + b"\0" * (-len(b) % n)
    free, end = 0xFFFFFFFF, 0xFFFFFFFE
    if small:  # the stream lies in blocks of 64 bytes, in the stream of the root
        content = pad(pad(book, 64), 512)
        n = len(content) // 512
        blocks = -(-len(book) // 64)
        directory = pad(entry("Root Entry", 5, 3, len(content)) + entry("Workbook", 2, 0, len(book)), 512)
        small_table = pad(b"".join(pack("<I", i + 1 if i + 1 < blocks else end) for i in range(blocks)), 512)
        assert len(small_table) == 512
        table = [0xFFFFFFFD, end, end, *[i + 4 if i + 1 < n else end for i in range(n)]]
        sectors = directory + small_table + content
    else:
        content = pad(book, 512)
        n = len(content) // 512
        directory = pad(entry("Root Entry", 5, end, 0) + entry("Workbook", 2, 2, len(book)), 512)
        table = [0xFFFFFFFD, end, *[i + 3 if i + 1 < n else end for i in range(n)]]
        sectors = directory + content
    table = b"".join(pack("<I", x) for x in table + [free] * (128 - len(table)))
    header = xls.MAGIC + b"\0" * 16 + pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + pack("<II", 1, 1) + b"\0" * 4
    header += pack("<IIIII", 4096, 2 if small else end, 1 if small else 0, end, 0) + pack("<I", 0) + pack("<I", free) * 108
    assert len(header) == 512
    return header + table + sectors


@pytest.mark.parametrize("small", [False, True])
def test_old_workbooks(spark, tmp_path, small):
    texts = ["name", "n", "when", "ok", "é plain", "日本 and more of it"]
    label = lambda r, c, i: record(0xFD, pack("<HHHI", r, c, 0, i))
    cells = b"".join(label(0, i, i) for i in range(4))
    cells += label(1, 0, 4) + record(0x27E, pack("<HHHI", 1, 1, 0, (1234 << 2) | 3)) + record(0x203, pack("<HHHd", 1, 2, 1, 45000.0)) + record(0x205, pack("<HHHBB", 1, 3, 0, 1, 0))
    cells += label(2, 0, 5) + record(0xBD, pack("<HH", 2, 1) + pack("<HI", 0, ((-7 & 0x3FFFFFFF) << 2) | 2) + pack("<HI", 2, 0x40E5F900) + pack("<H", 2))
    cells += record(0x06, pack("<HHH", 4, 0, 0) + bytes([0, 0, 0, 0, 0, 0, 255, 255]) + b"\0" * 8) + record(0x207, text("made")) + record(0x06, pack("<HHHd", 4, 1, 0, 0.125) + b"\0" * 8)
    path = tmp_path / "o.xls"
    path.write_bytes(old_workbook(texts, cells, small))
    got = [tuple(r) for r in files.load(spark, str(path), infer=False).orderBy("_row").collect()]
    assert got == [(2, "é plain", "12.34", "2023-03-15", "true"), (3, "日本 and more of it", "-7", "2023-03-15", None), (5, "made", "0.125", None, None)]
    assert files.load(spark, str(path), "zwei €").first()["only"] == 2.5
    with pytest.raises(IngestError, match="valid: Erstes, Zwei €"):
        files.load(spark, str(path), "Drei")
    (tmp_path / "no.xls").write_bytes(b"text")
    with pytest.raises(IngestError, match="no old workbook"):
        files.load(spark, str(tmp_path / "no.xls"))


def test_chat_over_a_transport():
    calls, replies = [], [PlannerError("busy"), {"message": {"content": "hello"}}]

    def transport(path, payload):
        calls.append((path, payload))
        if path == "/api/tags":
            return {"models": [{"name": "some-embed"}, {"name": "alpha:1"}, {"model": "beta:7"}]}
        reply = replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    chat = Chat(transport=transport, prefer=("gamma", "beta"))
    assert chat.available() and chat("hi") == "hello" and chat.model() == "beta:7"
    assert calls[2][1]["messages"][0]["content"] == "hi" and calls[2][1]["options"]["temperature"] == 0
    replies[:] = [{"message": {"content": "no json"}}, {"message": {"content": '{"value": "west"}'}}]
    assert chat.value("which zone?") == "west"
    replies[:] = [{"message": {"content": "x"}}, {}]
    assert chat.value("which zone?") == ""
    replies[:] = [PlannerError("down"), PlannerError("down")]
    with pytest.raises(PlannerError, match="down"):
        json_call(chat, "x")
    assert not Chat("http://127.0.0.1:9").available()
    with pytest.raises(PlannerError, match="no model"):
        Chat(transport=lambda p, x: {}).model()


def test_operations_by_name(spark, table):
    assert len(operations()) == 12
    df, jobs = table(["a"], [["x"], ["x"], ["y"]]), Jobs(spark)
    done = jobs.wait(jobs.run("validate", df, {"unique": ["a"], "auto": False}), 60)
    assert done["state"] == "done" and done["action"] == "validate" and done["result"].count() == 2
    failed = jobs.wait(jobs.run("clean", df, [{"op": "nope"}]), 60)
    assert failed["state"] == "error" and "nope" in failed["error"]
    with pytest.raises(TableError, match="kyc_dedupe"):
        jobs.run("magic")


def test_rules_for_a_stream(spark, table, tmp_path):
    first = table(["mail", "n"], [[f"u{i}@example.com" if i % 10 else "bad", i] for i in range(50)])
    rules = quality_stream.infer_rules(first)
    assert rules == {"formats": {"mail": "email"}}
    assert quality_stream.infer_rules(first.limit(10)) == {"formats": {}}
    found = quality_stream.validate_stream(first, rules)
    assert found.count() == 5
    rows = first.selectExpr("_row", "n % 3 AS k", "timestamp_seconds(n) AS at")
    twice = quality_stream.duplicate_rows(rows, "at", "1 hour")
    assert sorted((r["n"], r["first_row"]) for r in twice.collect()) == [(16, 4), (17, 2), (17, 3)]
