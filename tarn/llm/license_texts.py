"""License templates. The texts are fixed values: the published wording of each license or of its usual notice."""

from importlib.resources import files

_URL = "{w}. If not, see <https://www.gnu.org/licenses/>."
_ADDRESS = "{w}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."


def _gnu_notice(name: str, version: str, work: str = "program", end: str = _URL) -> str:
    """The notice of the GNU licenses."""
    return (
        f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the "
        f"Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {work} is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        f"or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} "
        "along with this " + end.format(w=work)
    )


#: (name, license, text)
TEMPLATES = (
    ("mit-line", "MIT", "Released under the MIT License."),
    ("mit-line-licensed", "MIT", "Licensed under the MIT License."),
    ("apache-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl3-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl2-line", "GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-line", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-line", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    (
        "mit",
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" "
        "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "bsd-2-clause",
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED "
        "BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
        "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "bsd-3-clause",
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED "
        "BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
        "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "apache-2.0-notice",
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    (
        "gpl-3.0-notice",
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have "
        "received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "mpl-2.0-notice",
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "zlib",
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
        "any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
        "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The "
        "origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered "
        "source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice "
        "may not be removed or altered from any source distribution.",
    ),
    (
        "unlicense",
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
    ),
    ("gpl-3.0-notice-address", "GPL-3.0-or-later", _gnu_notice("General Public License", "3", end=_ADDRESS)),
    ("gpl-2.0-notice", "GPL-2.0-or-later", _gnu_notice("General Public License", "2", end=_ADDRESS)),
    ("gpl-2.0-notice-url", "GPL-2.0-or-later", _gnu_notice("General Public License", "2")),
    ("lgpl-2.1-notice", "LGPL-2.1-or-later", _gnu_notice("Lesser General Public License", "2.1", "library", _ADDRESS)),
    ("lgpl-2.1-notice-url", "LGPL-2.1-or-later", _gnu_notice("Lesser General Public License", "2.1", "library")),
    ("lgpl-3.0-notice", "LGPL-3.0-or-later", _gnu_notice("Lesser General Public License", "3")),
    ("lgpl-3.0-notice-library", "LGPL-3.0-or-later", _gnu_notice("Lesser General Public License", "3", "library")),
    ("agpl-3.0-notice", "AGPL-3.0-or-later", _gnu_notice("Affero General Public License", "3")),
)

TEMPLATES += (
    (
        "bsd-4-clause",
        "BSD-4-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product "
        "includes software developed by the organization. 4. Neither the name of the copyright holder nor the names of its contributors may "
        "be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS "
        "PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
        "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "bsl-1.0",
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject "
        "to the following: The copyright notices in the Software and this entire statement, including the above license grant, this "
        "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative "
        "works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by "
        "a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "mit-0",
        "MIT-0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "epl-2.0-notice",
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
        "available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "epl-1.0-notice",
        "EPL-1.0",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ),
    (
        "wtfpl",
        "WTFPL",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as "
        "long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND "
        "MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    ),
)


def _gnu_only(name: str, version: str, work: str = "program") -> str:
    """The notice of the GNU licenses without "or any later version"."""
    return (
        f"This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} version {version} as "
        f"published by the Free Software Foundation. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        f"{name} for more details."
    )


TEMPLATES += tuple(
    (f"{spdx.lower()}-only-notice", f"{spdx}-only", _gnu_only(name, version, work))
    for spdx, name, version, work in (
        ("GPL-2.0", "General Public License", "2", "program"),
        ("GPL-3.0", "General Public License", "3", "program"),
        ("LGPL-2.1", "Lesser General Public License", "2.1", "library"),
        ("LGPL-3.0", "Lesser General Public License", "3", "library"),
        ("AGPL-3.0", "Affero General Public License", "3", "program"),
    )
) + (("lgpl-2.0-notice", "LGPL-2.0-or-later", _gnu_notice("Library General Public License", "2", "library", _ADDRESS)),)

#: Families of versioned licenses: (identifier, long name, short names, versions, whether "or later" is part of the license).
FAMILIES = (
    ("GPL", "GNU General Public License", ("GNU GPL", "GPL"), ("1.0", "2.0", "3.0"), True),
    ("LGPL", "GNU Lesser General Public License", ("GNU LGPL", "LGPL"), ("2.1", "3.0"), True),
    ("AGPL", "GNU Affero General Public License", ("GNU AGPL", "AGPL"), ("3.0",), True),
    ("Apache", "Apache License", ("Apache",), ("1.0", "1.1", "2.0"), False),
    ("MPL", "Mozilla Public License", ("MPL",), ("1.0", "1.1", "2.0"), False),
    ("EPL", "Eclipse Public License", ("EPL",), ("1.0", "2.0"), False),
    ("CDDL", "Common Development and Distribution License", ("CDDL",), ("1.0", "1.1"), False),
    ("BSL", "Boost Software License", (), ("1.0",), False),
    ("Artistic", "Artistic License", (), ("1.0", "2.0"), False),
    ("EUPL", "European Union Public Licence", ("EUPL",), ("1.1", "1.2"), False),
    ("AFL", "Academic Free License", ("AFL",), ("3.0",), False),
    ("OSL", "Open Software License", ("OSL",), ("3.0",), False),
    ("ODbL", "Open Database License", ("ODbL",), ("1.0",), False),
    ("OFL", "SIL Open Font License", ("OFL",), ("1.1",), False),
)
#: Licenses without a version: (identifier, names).
PLAIN = (
    ("MIT", ("MIT License", "MIT licence", "Expat License", "X11 MIT License")),
    ("ISC", ("ISC License",)),
    ("Zlib", ("zlib License",)),
    ("Unlicense", ("Unlicense License",)),
    ("BSD-2-Clause", ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License")),
    ("BSD-4-Clause", ("BSD 4-Clause License", "4-Clause BSD License", "Original BSD License")),
    ("CC0-1.0", ("CC0 1.0 Universal", "CC0 1.0 license", "Creative Commons Zero v1.0 Universal")),
    ("MIT-0", ("MIT No Attribution License", "MIT-0 License")),
    ("BSD", ("BSD License", "BSD-style License")),
)
# Further identifiers of the SPDX list.
OTHER_IDS = tuple("0BSD AFL-2.1 BlueOak-1.0.0 CPL-1.0 curl IPL-1.0 LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later MS-PL MS-RL NCSA OpenSSL PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 Ruby Unicode-3.0 UPL-1.0 Vim W3C WTFPL X11".split())
#: Clauses of the Creative Commons licenses by short and long name, and the versions' long forms.
CLAUSES = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
CC_VERSIONS = (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))
VERBS = ("Released", "Licensed", "Distributed", "Published", "Available")
#: Words that make another license of one they are put into.
FAMILY_WORDS = frozenset("affero lesser library nc nd sa noncommercial noderivatives noderivs sharealike".split())


def _versions(version: str, short: bool) -> tuple[str, ...]:
    """How a version is written: with or without "version" and "v", joined to a short name, and without a minor number of zero."""
    major, _, minor = version.partition(".")
    numbers = (version, major) if minor == "0" else (version,)
    return tuple(f"{lead}{n}" for n in numbers for lead in (", version ", " v", " ", *(("v",) if short else ())))


def names() -> list[tuple[str, str]]:
    """What lines call each license, by rule: each form of each name, with its article."""
    out: list[tuple[str, str]] = []
    for key, long, short, versions, later in FAMILIES:
        for version in versions:
            for name in (long, *short):
                for v in _versions(version, name in short):
                    out.append((f"{key}-{version}", f"the {name}{v}"))
                    if name == "Apache":
                        out.append((f"{key}-{version}", f"the {name}{v} License"))
                    if later:
                        out.append((f"{key}-{version}-only", f"the {name}{v} only"))
                        out += [(f"{key}-{version}-or-later", f"the {name}{v} or {any_}later") for any_ in ("", "any ", "at your option any ")]
    out += [(key, f"the {n}") for key, own in PLAIN for n in own]
    for version, form in CC_VERSIONS:
        for short, long in CLAUSES:
            key = f"CC-{short}-{version}"
            out += [(key, f"CC {short} {version}"), (key, f"the CC {short} {version} license")]
            out += [(key, f"{a} Creative Commons {long} {version}{end}") for a in ("a", "the") for end in ("", f" {form}", f" {form} License", " License")]
    return out


def identifiers() -> list[str]:
    """Identifiers that an SPDX line or a label may give."""
    own = [f"{key}-{version}{end}" for key, _, _, versions, later in FAMILIES for version in versions for end in (("", "-only", "-or-later") if later else ("",))]
    return own + [key for key, _ in PLAIN] + [f"CC-{short}-{version}" for version, _ in CC_VERSIONS for short, _ in CLAUSES] + list(OTHER_IDS)


def has_later(license: str) -> str | None:
    """The "or later" form of a license of a family that has one."""
    family = next((f for f in FAMILIES if f[4] and license in {f"{f[0]}-{v}" for v in f[3]}), None)
    return f"{license}-or-later" if family else None


def line_templates() -> tuple[tuple[str, str, str], ...]:
    """Lines such as "Released under the MIT License": each verb with each name of each license."""
    return tuple((f"line:{license}", license, f"{verb} under {name}.") for verb in VERBS for license, name in names())


#: Whole legal texts, one file each, by the SPDX identifier that the text alone stands for.
FULL_TEXTS = (
    ("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"),
    ("MPL-1.1", "MPL-1.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"),
)


def full_templates() -> tuple[tuple[str, str, str], ...]:
    folder = files("tarn.llm").joinpath("licenses")
    return tuple((f"text:{license}", license, folder.joinpath(f"{name}.txt").read_text(encoding="utf-8")) for name, license in FULL_TEXTS)


def templates() -> tuple[tuple[str, str, str], ...]:
    """All templates: notices and short licenses, whole texts, and lines by rule."""
    return TEMPLATES + full_templates() + line_templates()
