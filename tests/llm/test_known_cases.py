"""Cases that once went wrong."""

from __future__ import annotations

from pathlib import Path

import pytest

from lodestone.llm import licenses, neardup, pii
from lodestone.llm.licence_digests import DIGESTS
from lodestone.llm.licence_texts import LICENCES


def test_licences_on_one_line_and_full(spark):
    mit = " ".join(LICENCES["MIT (no heading)"].split())
    rows = [(1, f"Copyright (c) 2020 X. All rights reserved. {mit}"), (2, f"MIT License Copyright (c) 2020 X {mit}"), (3, "(c) 2020 X. Licensed under the MIT License."), (4, "Copyright (c) 2020 X, all texts")]
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    paths = {n: Path("/usr/share/common-licenses", f) for n, f in enumerate(names, 10)}
    rows += [(n, p.read_text(encoding="utf-8")) for n, p in paths.items() if p.exists()]
    got = {r["doc_id"]: r for r in licenses.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["license_id"] == "MIT (no heading)" and got[2]["license_id"] == "MIT" and got[4]["license_id"] is None
    assert got[3]["license_id"].startswith("MIT (notice") and got[3]["notices"] == [got[3]["license_id"]]
    assert all(got[n]["license_id"] == names[p.name] for n, p in paths.items() if n in got)
    assert set(DIGESTS.values()) == set(names.values())


def test_pseudonyms_beside_other_numbers():
    cipher, card = pii.Cipher(b"k"), "4111 1111 1111 1111"
    for text in (f"card {card} 12/25", f"{card} 123", f"12 {card}", f"1234 {card} 12", *(f"{card} {n:03d} x" for n in range(300))):
        new, counts = pii.pseudonymise(text, cipher)
        assert counts == {"card": 1} and new != text and (card not in new)
        assert pii.pseudonymise(new, cipher, back=True) == (text, counts)
    iban = "GB29 NWBK 6016 1331 9268 19"
    for text in ("2020-05-13T10:00:00Z", "on 2020/05/13.", "2020/05/13T10:00", f"{iban} ABC", "DE89 3704 0044 0532 0130 00 12", "AT61 1904 3002 3457 3201 CARD"):
        new, counts = pii.pseudonymise(text, cipher)
        assert sum(counts.values()) == 1 and new != text and pii.pseudonymise(new, cipher, back=True)[0] == text


def test_jaccard_join_says_when_recall_is_not_met(spark):
    rows = [(n, " ".join([f"w{k}" for k in range(300)] + [f"x{n}"])) for n in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with pytest.raises(ValueError, match="runs miss"):
        neardup.jaccard_classes(docs, threshold=0.5).count()
    assert neardup.jaccard_classes(docs).count() >= 150
