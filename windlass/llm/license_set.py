"""The templates that license scans look for: lines, identifiers, notices and whole texts.

A template's name is the license's SPDX name in lower case, and its form: ``-line``,
``-brief`` and ``-name`` for wordings of one sentence, ``-spdx`` for identifiers, ``-url``
for Creative Commons addresses, ``-notice`` for what is put into files, none for a short
license's text and ``-text`` for the whole text of a long one.
"""

from __future__ import annotations

from functools import cache
from importlib.resources import files

# Licenses, notices and names, as published.
_GNU = {
    "gpl": ("GNU General Public License", "GPL", ("1.0", "2.0", "3.0")),
    "lgpl": ("GNU Lesser General Public License", "LGPL", ("2.1", "3.0")),
    "agpl": ("GNU Affero General Public License", "AGPL", ("1.0", "3.0")),
    "gfdl": ("GNU Free Documentation License", "GFDL", ("1.1", "1.2", "1.3")),
}
_CC = {
    "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
_CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
#: SPDX identifier, and the sentence's name of the license.
_NAMED = {
    "Apache-1.0": "Apache License, Version 1.0", "Apache-1.1": "Apache License, Version 1.1", "Apache-2.0": "Apache License, Version 2.0", "MIT": "MIT License", "ISC": "ISC License", "Zlib": "zlib License",
    "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "BSD-4-Clause": "BSD 4-Clause License", "0BSD": "BSD Zero Clause License",
    "MPL-1.0": "Mozilla Public License, Version 1.0", "MPL-1.1": "Mozilla Public License, Version 1.1", "MPL-2.0": "Mozilla Public License, Version 2.0",
    "EPL-1.0": "Eclipse Public License, Version 1.0", "EPL-2.0": "Eclipse Public License, Version 2.0", "BSL-1.0": "Boost Software License, Version 1.0",
    "Artistic-1.0": "Artistic License 1.0", "Artistic-2.0": "Artistic License 2.0", "CDDL-1.0": "Common Development and Distribution License, Version 1.0", "CDDL-1.1": "Common Development and Distribution License, Version 1.1",
    "EUPL-1.1": "European Union Public License, Version 1.1", "EUPL-1.2": "European Union Public License, Version 1.2", "MS-PL": "Microsoft Public License", "PSF-2.0": "Python Software Foundation License, Version 2",
    "OFL-1.1": "SIL Open Font License, Version 1.1", "OSL-3.0": "Open Software License, Version 3.0", "AFL-3.0": "Academic Free License, Version 3.0", "ODbL-1.0": "Open Database License, Version 1.0", "CPL-1.0": "Common Public License, Version 1.0",
    "CC0-1.0": "Creative Commons Zero 1.0 Universal License", "Unlicense": "The Unlicense", "WTFPL": "Do What The Fuck You Want To Public License", "LGPL-2.0": "GNU Library General Public License, Version 2",
}
_WARRANTY = "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_SHORT = {
    "bsd-3-clause": f"{_BSD} 3. {_BSD_NAMES}",
    "bsd-4-clause": f"{_BSD} 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. {_BSD_NAMES}",
    "0bsd": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means.""",
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant,
this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor.""",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    "bsl-1.0-notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl-1.1-notice": """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/
Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License.""",
    "epl-1.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-1.0-dedication": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "cc0-1.0-url": "creativecommons.org/publicdomain/zero/1.0",
    "gfdl-1.2-notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation",
    "gfdl-1.3-notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation",
}
_AGPL_13 = """13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely
through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge,
through some standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GNU General Public License that is incorporated
pursuant to the following paragraph. Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work licensed under version 3 of the GNU General Public License into a single combined work,
and to convey the resulting work. The terms of this License will continue to apply to the part which is the covered work, but the work with which it is combined will remain governed by version 3 of the GNU General Public License.
"""


def _gnu(name: str, title: str, letters: str, version: str) -> dict[str, str]:
    number = version.removesuffix(".0")
    out = {
        f"{name}-{version}-line": f"This work is licensed under the {title}, version {number}.",
        f"{name}-{version}-or-later-line": f"This work is licensed under the {title}, version {number} or any later version.",
        f"{name}-{version}-name": f"under the {title} version {number}",
        f"{name}-{version}-or-later-name": f"under the {title} version {number} or later",
        f"{name}-{version}-v-name": f"under the {title} v{version}",
        f"{name}-{version}-brief": f"Licensed under the {letters}v{number}.",
        f"{name}-{version}-v-brief": f"Licensed under the {letters} v{number}.",
        f"{name}-{version}-id-brief": f"Licensed under {letters}-{version}.",
        f"{name}-{version}-gnu-brief": f"under the GNU {letters} version {number}",
    }
    out |= {f"{name}-{version}{end}-spdx": f"SPDX-License-Identifier: {letters}-{version}{end}" for end in ("", "-only", "-or-later")}
    if name != "gfdl":
        for what in ("program", "library") if name == "lgpl" else ("program",):
            first, rest = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation, ", " " + _WARRANTY.format(what=what, name=title)
            form = "-notice" if what == "program" else f"-{what}-notice"
            out[f"{name}-{version}{form}"] = f"{first}either version {number} of the License, or (at your option) any later version.{rest}"
            out[f"{name}-{version}-only{form}"] = f"{first}version {number} of the License.{rest}"
    return out


def _cc(kind: str, title: str, version: str, region: str) -> dict[str, str]:
    name, letters = f"cc-{kind}-{version}", f"CC {kind.upper()}"
    title = title if version == "4.0" else title.replace("NoDerivatives", "NoDerivs")
    return {
        f"{name}-line": f"Licensed under {letters} {version}.",
        f"{name}-the-line": f"This work is licensed under the {letters} {version} license.",
        f"{name}-name": f"This work is licensed under a Creative Commons {title} {version} {region} License.",
        f"{name}-brief": f"Licensed under Creative Commons {title} {version}.",
        f"{name}-spdx": f"SPDX-License-Identifier: CC-{kind.upper()}-{version}",
        f"{name}-url": f"creativecommons.org/licenses/{kind}/{version}",
    }


def short_templates() -> dict[str, str]:
    """Lines, identifiers, notices and short licenses."""
    out = {}
    for name, (title, letters, versions) in _GNU.items():
        for v in versions:
            out |= _gnu(name, title, letters, v)
    for kind, title in _CC.items():
        for v, region in _CC_VERSIONS.items():
            out |= _cc(kind, title, v, region)
    for spdx, title in _NAMED.items():
        the = "" if title.startswith("The ") else "the "
        out |= {f"{spdx.lower()}-line": f"Licensed under {the}{title}.", f"{spdx.lower()}-spdx": f"SPDX-License-Identifier: {spdx}"}
        out[f"{spdx.lower()}-id-brief"] = f"Licensed under {spdx}."
    return out | _SHORT


@cache
def long_templates() -> dict[str, str]:
    """Whole texts, read from the package on the driver."""
    folder = files(__package__) / "license_texts"
    out = {f.name.removesuffix(".txt") + "-text": f.read_text("utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
    # The terms of the AGPL are those of the GPL but for its name and section 13.
    body = out["gpl-3.0-text"]
    body = body[body.index("TERMS AND CONDITIONS") : body.index("END OF TERMS AND CONDITIONS")]
    before, after = body.index("13. Use with"), body.index("14. Revised Versions")
    affero = lambda s: " ".join(s.split()).replace("GNU General Public License", "GNU Affero General Public License") + " "
    out["agpl-3.0-text"] = affero(body[:before]) + _AGPL_13 + affero(body[after:])
    return out
