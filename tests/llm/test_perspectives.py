from __future__ import annotations

from runsieve.llm import perspectives

SCHEMA = "conv_id long, turn long, role string, text string, perspective string, start int, copies int"


def chats(spark, rows):
    return spark.createDataFrame([(*row, "clash", 1, 2) for row in rows], SCHEMA)


ROWS = [
    (1, 0, "ann", "hello"), (1, 1, "bob", "hi\nthere"), (1, 2, "cleo", ""), (1, 3, "ann", None),
    (1, 3, "bob", "tie"), (1, 3, "bob", "tie"), (2, None, None, "no name"), (2, 5, "user", "é" * 4000),
    (None, 1, "x", "lost"),
]


def rendered(rows, conv, who):
    turns = [(t, s or "", x or "") for c, t, s, x in rows if c == conv]
    import hashlib

    turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    parts = []
    for _, speaker, text in turns:
        head = "<|assistant|>\n" if speaker == who else f"<|user name={speaker}|>\n"
        parts.append((head + text + "\n<|end|>\n", speaker == who, len(head)))
    return parts


def test_every_perspective_against_plain_python(spark):
    rows = ROWS + [(3, i % 50, f"s{i % 3}", f"text {i}") for i in range(300)]
    found = {}
    for row in perspectives.rotate(chats(spark, rows)).collect():
        found.setdefault((row.conv_id, row.perspective), []).append(row)
    people = {(c, s or "") for c, _, s, _ in rows}
    assert set(found) == people
    for (conv, who), segments in found.items():
        segments.sort(key=lambda row: row.position)
        wanted = rendered(rows, conv, who)
        assert [row.segment for row in segments] == [part for part, _, _ in wanted]
        at = 0
        for place, (row, (part, own, head)) in enumerate(zip(segments, wanted)):
            assert (row.position, row.start, row.length, row.mask) == (place, at, len(part), int(own))
            span = (at + head, at + len(part)) if own else (None, None)
            assert (row.mask_start, row.mask_end) == span
            at += len(part)


def test_empty_table(spark):
    assert perspectives.rotate(chats(spark, [])).count() == 0
