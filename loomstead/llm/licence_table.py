"""The licences that are looked for: whole texts, headers, notices and identifiers.

The whole texts are files of ``licence_texts``, read on the driver.  Creative
Commons licences (but CC0), AGPL, EPL, EUPL and BSL are known by their notices
and identifiers alone, as their texts are not at hand.

``keys`` are the words that tell a licence or version from its neighbours; all
of them must be among the aligned words.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path
from typing import NamedTuple

#: Words of licence notices that tell no licence from another.
GENERIC = frozenset(
    "a all an and any are as at be by can code distributed file following for free from in international is it its later licence licences licensed license licenses made may modify "
    "no of on option or or-later program provided redistribute released rights see software source subject terms that the this to under unported use v version versions with work you your".split()
)
#: A template of at most so many words has its own words outside ``GENERIC`` as keys, where none are given.
NOTICE_WORDS = 40


class Template(NamedTuple):
    licence: str
    text: str
    keys: frozenset[str] | None = None


#: Keys of the whole texts.
TEXTS = {
    "0BSD": "fee granted whatsoever",
    "Apache-2.0": "apache 2.0 contributor",
    "Artistic-1.0-Perl": "artistic package",
    "BSD-2-Clause": "redistributions disclaimer",
    "BSD-3-Clause": "redistributions disclaimer endorse",
    "CC0-1.0": "cc0 affirmer waiver",
    "GFDL-1.2": "1.2 invariant opaque",
    "GFDL-1.3": "1.3 invariant opaque",
    "GPL-1.0": "gnu general public 1989",
    "GPL-2.0": "gnu general public 1991 sublicense",
    # The next two words are not in the AGPL, which has nearly all the others.
    "GPL-3.0": "gnu general public systematic abuse",
    "ISC": "fee granted whatsoever appear",
    "LGPL-2.0": "gnu library general public 1991",
    "LGPL-2.1": "gnu lesser general public 2.1",
    "LGPL-3.0": "gnu lesser general public 3",
    "MIT": "sublicense noninfringement substantial",
    "MPL-1.1": "mozilla 1.1 contributor",
    "MPL-2.0": "mozilla 2.0 contributor",
    "Unlicense": "unencumbered domain successors",
    "Zlib": "misrepresented altered appreciated",
}

_ADVERT = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation;
either version {} of the License, or (at your option) any later version."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""
_GNU_KINDS = (("GPL", "", "1"), ("GPL", "", "2"), ("GPL", "", "3"), ("LGPL", "Library ", "2"), ("LGPL", "Lesser ", "2.1"), ("LGPL", "Lesser ", "3"), ("AGPL", "Affero ", "3"))
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_OTHERS = (("MIT", "MIT"), ("ISC", "ISC"), ("Zlib", "zlib"), ("0BSD", "Zero-Clause BSD"), ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause"), ("BSD", "BSD"))
_VERSIONED = (("Apache-2.0", "Apache License", "2.0"), ("MPL-1.1", "Mozilla Public License", "1.1"), ("MPL-2.0", "Mozilla Public License", "2.0"), ("EPL-1.0", "Eclipse Public License", "1.0"), ("EPL-2.0", "Eclipse Public License", "2.0"), ("EUPL-1.2", "European Union Public Licence", "1.2"), ("BSL-1.0", "Boost Software License", "1.0"), ("Artistic-2.0", "Artistic License", "2.0"))


@cache
def licence_table() -> tuple[Template, ...]:
    """All templates; those of one licence have the same SPDX identifier."""
    folder = Path(__file__).with_name("licence_texts")
    bodies = {name: (folder / f"{name}.txt").read_text(encoding="utf-8") for name in TEXTS}
    out = [Template(name, text, frozenset(TEXTS[name].split())) for name, text in bodies.items()]
    out.append(Template("BSD-4-Clause", bodies["BSD-3-Clause"].replace(" * Neither", f" * {_ADVERT}\n * Neither"), frozenset("redistributions disclaimer endorse advertising".split())))
    out += [Template("Apache-2.0", _APACHE, frozenset(("apache", "2.0"))), Template("MPL-2.0", _MPL, frozenset(("mozilla", "2.0")))]
    out.append(Template("all-rights-reserved", "All rights reserved.", frozenset(("all", "rights", "reserved"))))
    for short, kind, version in _GNU_KINDS:
        name = f"{short}-{version}" if "." in version else f"{short}-{version}.0"
        keys = frozenset(f"gnu {kind}general public".lower().split())
        out.append(Template(name, _GNU.format(kind, version), keys | {version}))
        for v in dict.fromkeys((version, name.split("-")[1], f"v{version}")):
            out += [Template(name, f"This work is licensed under the GNU {kind}General Public License, version {v}.", keys | {v}), Template(name, f"GNU {kind}General Public License version {v}", keys | {v})]
    for name, title in _OTHERS:
        out += [Template(name, f"Released under the {title} License."), Template(name, f"The {title} License")]
    out += [Template(name, f"Licensed under the {title}, Version {v}.") for name, title, v in _VERSIONED]
    for short, title in _CC.items():
        for v in ("2.0", "2.5", "3.0", "4.0"):
            own = title if v == "4.0" else title.replace("NoDerivatives", "NoDerivs")
            out += [Template(f"CC-{short}-{v}", f"Licensed under CC {short} {v}."), Template(f"CC-{short}-{v}", f"This work is licensed under a Creative Commons {own} {v} License.")]
    ids = dict.fromkeys(t.licence for t in out if t.licence not in ("all-rights-reserved", "BSD"))
    out += [Template(x, f"SPDX-License-Identifier: {x}{end}") for x in ids for end in (("", "-only", "-or-later") if "GPL" in x or "GFDL" in x else ("",))]
    return tuple(out)
