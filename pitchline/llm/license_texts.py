"""Public licence texts and the notices by which works name their licence, as (licence, text).

Texts of a licence come first, then standard headers, then short notices. Notices that differ in a name or a version
only are made by a rule.
"""

_DISCLAIMED = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software. "
)

_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies. "
)

_ISC_DISCLAIMED = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution. "
)

_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. "
)

_BSD_DISCLAIMED = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
    "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
    "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
    "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
    "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
    "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
    "original software. 3. This notice may not be removed or altered from any source distribution."
)

_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
    'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and '
    "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software "
    "is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, "
    "including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
    "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely "
    "in the form of machine-executable object code generated by a source language processor. "
)

_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
    "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial "
    "or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
    "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
    "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
    "relinquishment in perpetuity of all present and future rights to this software under copyright law. "
)

_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
    "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
    'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
    "limitations under the License."
)

_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
    "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
)

_EPL = (
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
    "available at https://www.eclipse.org/legal/epl-2.0/"
)

_CC0 = (
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."
)

_GFDL = (
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, "
    "Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, "
    "and no Back-Cover Texts. A copy of the license is included in the section entitled GNU Free Documentation License."
)


def _gnu_header(work: str, licence: str, version: str, later: bool) -> str:
    """The standard header of the GNU licences."""
    which = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version} of the License."
    return (
        f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {licence} as published "
        f"by the Free Software Foundation, {which} This {work} is distributed in the hope that it will be useful, but WITHOUT ANY "
        f"WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {licence} "
        f"for more details. You should have received a copy of the GNU {licence} along with this {work}. If not, see "
        "<https://www.gnu.org/licenses/>."
    )


_GNU = (
    ("agpl-3.0", "program", "Affero General Public License", "3"),
    ("gpl-2.0", "program", "General Public License", "2"),
    ("gpl-3.0", "program", "General Public License", "3"),
    ("lgpl-2.1", "library", "Lesser General Public License", "2.1"),
    ("lgpl-3.0", "library", "Lesser General Public License", "3"),
)

#: Notices that name no version.
_UNVERSIONED = (("agpl", "Affero General Public License"), ("gpl", "General Public License"), ("lgpl", "Lesser General Public License"))

#: SPDX identifiers in lower case. One that isn't here is found as spdx-other.
_SPDX = ("agpl-3.0", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc0-1.0", "epl-2.0", "gfdl-1.3", "gpl-2.0", "gpl-3.0", "isc", "lgpl-2.1", "lgpl-3.0", "mit", "mpl-2.0", "unlicense", "zlib")

_CC = (
    ("by", "Attribution"),
    ("by-nc", "Attribution-NonCommercial"),
    ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
    ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
    ("by-nd", "Attribution-NoDerivatives"),
    ("by-sa", "Attribution-ShareAlike"),
)

TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", _MIT + _DISCLAIMED),
    ("mit", _MIT),
    ("isc", _ISC + _ISC_DISCLAIMED),
    ("isc", _ISC),
    ("bsd-2-clause", _BSD),
    ("bsd-3-clause", _BSD + _BSD_NAMES),
    ("bsd-2-clause", _BSD + _BSD_DISCLAIMED),
    ("bsd-3-clause", _BSD + _BSD_NAMES + _BSD_DISCLAIMED),
    ("zlib", _ZLIB),
    ("bsl-1.0", _BOOST + _DISCLAIMED),
    ("unlicense", _UNLICENSE + _DISCLAIMED),
    ("apache-2.0", _APACHE),
    ("mpl-2.0", _MPL),
    ("epl-2.0", _EPL),
    ("cc0-1.0", _CC0),
    ("gfdl-1.3", _GFDL),
    *[(name, _gnu_header(work, licence, version, later)) for name, _, licence, version in _GNU for work in ("program", "library") for later in (True, False)],
    *[(name, f"This work is licensed under the GNU {licence}, version {version}.") for name, _, licence, version in _GNU],
    *[(name, f"This {work} is licensed under the GNU {licence}, version {version}.") for name, work, licence, version in _GNU],
    *[(f"cc-{code}-{v}", f"This work is licensed under a Creative Commons {name} {v} {port} License.") for code, name in _CC for v, port in (("4.0", "International"), ("3.0", "Unported"))],
    *[(f"cc-{code}-{v}", f"Licensed under CC {code.upper()} {v}.") for code, _ in _CC for v in ("4.0", "3.0")],
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License 2.0."),
    *[(name, f"Licensed under the GNU {licence} v{version if '.' in version else version + '.0'}.") for name, _, licence, version in _GNU],
    *[(name, f"Licensed under the GNU {licence}.") for name, licence in _UNVERSIONED],
    *[(name, f"SPDX-License-Identifier: {name}") for name in _SPDX],
    ("spdx-other", "SPDX-License-Identifier:"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd-style", "Use of this source code is governed by a BSD-style license."),
    ("public-domain", "This work has been dedicated to the public domain."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
)
