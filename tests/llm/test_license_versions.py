from gridmill.llm import licenses, warc

GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
LGPL = GPL.replace("program", "library").replace("General Public", "Lesser General Public")

#: Texts that are no template, with the licence that a reader would name.
LABELLED = [
    (GPL.format(2), "GPL-2.0"), (GPL.format(3), "GPL-3.0"), (LGPL.format(3), "LGPL-3.0"), (LGPL.format("2.1"), "LGPL-2.1"),
    (LGPL.replace("library", "file").format(3), "LGPL-3.0"), (GPL.replace("program", "file").format(2), "GPL-2.0"), (GPL.replace("program", "script").format(3), "GPL-3.0"),
    ("# " + GPL.format(2), "GPL-2.0"), ("Copyright 2019 Jo. " + GPL.format(3), "GPL-3.0"), (GPL.replace("General", "Affero General").format(3), "AGPL-3.0"),
    ("Licensed under CC BY 3.0.", "CC-BY-3.0"), ("licensed under cc by 4.0", "CC-BY-4.0"), ("This text is licensed under CC BY 4.0", "CC-BY-4.0"), ("This text is licensed under CC BY 3.0", "CC-BY-3.0"),
    ("Licensed under CC BY-SA 3.0", "CC-BY-SA-3.0"), ("This work is licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Images licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "CC-BY-4.0"), ("This work is licensed under a Creative Commons Attribution 3.0 Unported License", "CC-BY-3.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"), ("This page is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
    ('The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.', "MPL-1.1"),
    ("This file is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "MPL-2.0"),
    ("// This Source Code Form is subject to the terms of the Mozilla Public", "MPL-2.0"),
    ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("// SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), ("spdx-license-identifier: mpl-2.0", "MPL-2.0"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"), ("SPDX-License-Identifier: CC0-1.0", "CC0-1.0"), ("SPDX-License-Identifier: ISC", "ISC"), ("SPDX-License-Identifier: CC-BY-SA-4.0", "CC-BY-SA-4.0"),
    ("SPDX-License-Identifier: Zlib", None), ("SPDX-License-Identifier: EPL-2.0", None), ("SPDX-License-Identifier: LicenseRef-Own", None),
    ("This is not licensed under the MIT License.", None), ("This file is no longer licensed under the MIT License.", None), ("It was never released under the MIT License.", None), ("Not available under the Apache License, Version 2.0.", None),
    ("Redistribution and use in source and binary forms are not permitted.", None), ("This code isn't licensed, under the ISC License or any other", None),
    ("Licensed under the MIT license", "MIT"), ("Released under the MIT licence", "MIT"), ("code released under the MIT License", "MIT"), ("Licensed under the terms of the MIT License", "MIT"), ("Licensed under the ISC license", "ISC"),
    ("Licensed under the Apache License, Version 2.0", "Apache-2.0"), ("licensed under the apache license version 2.0 only", "Apache-2.0"), ("Licensed under the Apache License, Version 1.1", None),
    ("Licensed under the BSD 2-Clause License", "BSD-2-Clause"), ("Licensed under the BSD 3-Clause License", "BSD-3-Clause"), ("All rights reserved", "Proprietary"), ("© All rights reserved.", "Proprietary"),
    ("This is free and unencumbered software released to the public domain", "Unlicense"), ("Redistribution and use in source and binary forms is permitted.", "BSD-3-Clause"),
    ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"), ("This work is licensed under the GNU General Public License, version 3", "GPL-3.0"), ("This work is licensed under the GNU General Public License, version 1", None),
    ("The licence of a driver is not the licence of a car", None), ("He had permission to use the boat", None), ("MIT is a university", None), ("a warranty of two years", None), ("The public domain is large", None), ("She reserved all seats; the rights came later", None),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_labelled_lines(spark):
    got = {r.path: r.license for r in licenses.notices(frame(spark, [(str(i), t) for i, (t, _) in enumerate(LABELLED)])).collect()}
    named = [(got.get(str(i)), want) for i, (_, want) in enumerate(LABELLED)]
    right = sum(1 for a, b in named if a == b and a)
    wrong = [(LABELLED[i], a) for i, (a, b) in enumerate(named) if a and a != b]
    precision, recall = right / sum(1 for a, _ in named if a), right / sum(1 for _, b in named if b)
    missed = [LABELLED[i] for i, (a, b) in enumerate(named) if b and not a]
    print(f"precision {precision:.3f}, recall {recall:.3f} of {len(LABELLED)}", wrong, missed)
    assert len(LABELLED) >= 60 and precision >= 0.97 and recall >= 0.9, (wrong, missed)


def test_files_of_two_and_three_clauses(spark):
    of = lambda name: [t for n, t in licenses.NOTICES if n == name and len(t.split()) >= licenses.PARAGRAPH]
    code = "\nimport os\n\ndef f(x):\n    return os.path.join(x, 'y')\n" * 40
    rows = [
        ("a/2", "Copyright 2020 Some One\n\n" + "\n\n".join(of("BSD-2-Clause"))), ("a/3", "Copyright 2020 Some One\n\n" + "\n\n".join(of("BSD-3-Clause"))),
        ("b/2", "\n".join(of("BSD-2-Clause")) + code), ("b/3", "\n\n".join(of("BSD-3-Clause")) + code), ("g/2", "\n\n".join(of("GPL-2.0")) + code), ("g/3", "\n\n".join(of("GPL-3.0")) + code),
    ]
    got = {r.path: r.license for r in licenses.notices(frame(spark, rows)).collect()}
    assert got == {"a/2": "BSD-2-Clause", "a/3": "BSD-3-Clause", "b/2": "BSD-2-Clause", "b/3": "BSD-3-Clause", "g/2": "GPL-2.0", "g/3": "GPL-3.0"}


def test_pages_at_the_address_of_a_version_block(spark):
    same, other = "x" * 200, "1 0 writer\nURL IP-address Archive-date Content-type Archive-length\n" * 9
    rows = [(1, "filedesc:x", same), (2, "http://a", same), (3, "filedesc://pages.arc", other), (4, "FileDesc:y", other), (5, "filedesc:", None), (6, "http://b", same), (7, "filedesc:x", "short")]
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    n = len(other)
    assert got == {1: (200, "response", None), 2: (200, "revisit", 1), 3: (n, "response", None), 4: (n, "revisit", 3), 5: (0, "response", None), 6: (200, "revisit", 1), 7: (5, "response", None)}


def test_foreign_records_at_reserved_addresses():
    note = b"1 0 x\nfields\n"
    head = b"filedesc://f 0.0.0.0 20200102 text/plain %d\n%s\n" % (len(note), note)
    raw = head + b"filedesc://g 1.2.3.4 20200102030405 text/html 5\nhello\nfiledesc://h 1.2.3.4 20200102030405 text/plain 5\n1 day\nhttp://a 1.2.3.4 20200102030405 text/plain 2\nhi\n"
    assert [(r["fields"]["URL"], r["block"]) for r in warc.arc_records(raw)] == [("filedesc://g", b"hello"), ("filedesc://h", b"1 day"), ("http://a", b"hi")]
