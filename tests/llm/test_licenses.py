"""Each licence notice gives its own licence and no other one."""

import pytest

from ledgerwatch.llm import licenses as li

GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU{} General Public License as published by\n"
    "the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
BSD = (
    "Copyright (c) 2019, Some Body\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.\n"
)
THIRD = "3. Neither the name of Some Body nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"

NOTICES = [
    (GNU.format("", "3"), {"GPL-3.0"}),
    (GNU.format("", "2"), {"GPL-2.0"}),
    (GNU.format(" Lesser", "3"), {"LGPL-3.0"}),
    (GNU.format(" Lesser", "2.1").replace("This program", "This library"), {"LGPL-2.1"}),
    (GNU.format(" Affero", "3"), {"AGPL-3.0"}),
    (BSD, {"BSD-2-Clause"}),
    (BSD + THIRD, {"BSD-3-Clause"}),
    (BSD + THIRD + "\n\nSome other file.\n\n" + BSD, {"BSD-2-Clause", "BSD-3-Clause"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one there.", {"MPL-2.0"}),
    (
        "This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:", {"Zlib"},
    ),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", {"Apache-2.0"}),
]
NAMED = [
    (phrase.format(f"{title}" if "icense" in title else f"{title} License"), {name})
    for names in (li.NAMES, li.OTHER_NAMES) for name, title in names.items() for phrase in ("This work is licensed under the {}.", "It is released under the {}.")
]


def found(text):
    return {row[2] for row in li.scan(text)} - {"all-rights-reserved"}


@pytest.mark.parametrize("text, want", NOTICES)
def test_notices(text, want):
    assert found(text) == want
    assert found(f"Some words before it.\n\n{text}\n\nAnd some behind.") == want


def test_names_tell_one_licence_each():
    wrong = [(text, found(text)) for text, want in NAMED if found(text) != want]
    assert not wrong


@pytest.mark.parametrize("text", [
    "This software is not licensed under the MIT License.",
    "The code is no longer released under the MIT License.",
    "It may never be distributed under the terms of the MIT License.",
    "This work isn't licensed under the MIT License.",
])
def test_denied_licences_are_not_found(text):
    assert found(text) == set()


def test_a_denial_reaches_its_own_clause_only():
    assert found("This is not a library, it is licensed under the MIT License.") == {"MIT"}
    assert found("It does not cost anything. Licensed under the MIT License.") == {"MIT"}
    assert found("Licensed under the MIT License, not the GNU General Public License, version 3.") == {"MIT"}
