"""Writes license_digests.py from a folder of licence texts (Debian's by default): python -m salesframe.llm.make_license_digests."""

import sys
from pathlib import Path

from pyspark.sql import functions as F

from ..session import build_session
from . import license_scan as L

NAMES = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0",
         "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0",
         "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
END = "END OF TERMS AND CONDITIONS"


def texts(folder: str) -> list[tuple[str, str]]:
    """Whole texts, and the terms alone where a text goes on after them."""
    found = []
    for file, name in NAMES.items():
        text = Path(folder, file).read_text()
        found.append((name, text))
        if END in text:
            found += [(name, text[:text.index(END) + len(END)]), (name, text[:text.index(END)])]
    return found


def main(folder: str = "/usr/share/common-licenses") -> None:
    spark = build_session("local[2]", 2)
    form = F.regexp_replace("form", r"^[ \n]+|[ \n]+$", "")
    rows = L._forms(spark.createDataFrame(texts(folder), "license string, text string"), "text").withColumn("form", form)
    parts = F.split("form", L.BLANK)
    rows = rows.select("license", F.size(parts), L._flat(parts[0]), F.sha2(L._flat(F.col("form")), 256)).distinct()
    lines = "\n".join(f"    {tuple(r)!r}," for r in sorted(rows.collect()))
    out = Path(__file__).resolve().parent / "license_digests.py"
    out.write_text('"""Long licence texts: (licence, paragraphs, first paragraph, SHA-256 of the whole), in canonical form.\n\n'
                   'Written by make_license_digests.py.\n"""\n\n# Fixed values: whole texts, and those without what follows their '
                   f'terms.\nFULL = [\n{lines}\n]\n')


if __name__ == "__main__":
    main(*sys.argv[1:])
