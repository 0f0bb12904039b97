import pytest

from attesta.llm import license_scan as L

NOTICE = "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Released under the BSD License.", {"BSD"}),
        ("Licensed under the BSD License; MIT is a school.", {"BSD"}),
        ("Licensed under CC BY 4.0", {"CC-BY"}),
        ("Licensed under CC BY-SA 4.0", {"CC-BY-SA"}),
        ("Licensed under CC BY-NC 4.0", {"CC-BY-NC"}),
        ("Licensed under CC BY-NC-SA 4.0", set()),
        ("Licensed under CC BY-ND 4.0", set()),
        ("Licensed under CC BY-NC-ND 4.0", set()),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", set()),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"CC-BY-SA"}),
        ("Licensed under CC0 1.0", {"CC0"}),
        ("Licensed under the Mozilla Public License, Version 2.0", {"MPL"}),
        ("Licensed under the Eclipse Public License, Version 2.0", {"EPL"}),
        ("Licensed under the Zope Public License, Version 2.0", set()),
        ("Licensed under the Educational Community License, Version 2.0", set()),
        ("Licensed under the Apache License, Version 1.0", set()),
        (f"Licensed under the Apache License, Version 2.0 (the License); {NOTICE}", {"Apache-2.0"}),
        (f"Licensed under the Educational Community License, Version 2.0 (the License); {NOTICE}", set()),
        (f"Licensed under the Apache License, Version 1.1 (the License); {NOTICE}", set()),
        ("Released under the Python License.", set()),
        ("Released under the MIT-0 License.", set()),
        ("Released under the Zlib License. Written at MIT.", set()),
        ("Released under the MIT", {"MIT"}),
        ("Released under the BSD License and under the MIT License.", {"BSD", "MIT"}),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", {"LGPL"}),
        ("This work is licensed under the GNU Affero General Public License, version 3.", {"AGPL"}),
        ("This work is licensed under the GNU Free Documentation License, version 3.", set()),
        (GNU.format("General Public License"), {"GPL"}),
        (GNU.format("Lesser General Public License"), {"LGPL"}),
        (GNU.format("Library General Public License"), {"LGPL"}),
        (GNU.format("Affero General Public License"), {"AGPL"}),
        ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted", set()),
    ],
)
def test_only_the_named_license(text, want):
    for said in (text, f"Some prose before it. {text} And some more prose.", text.upper()):
        assert {m[0] for m in L.Scanner().scan(said)} == want, said
