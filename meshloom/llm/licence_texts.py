"""Templates of the license scan: label, text, and the key phrases that must stand in it word for word.

Texts and phrases are fixed values, with the wording of the public licences; the scan reads only their words.
"""

NOT_WARRANTED = (
    "IN NO EVENT SHALL {holder} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF"
    " SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,"
    " OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source"
    " code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright"
    " notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF'
    " MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. " + NOT_WARRANTED.format(holder="THE COPYRIGHT HOLDER OR CONTRIBUTORS")
)
GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {v}"
    " of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
    " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)

TEXTS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
        " persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all"
        " copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE"
        " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR"
        " OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ("permission is hereby granted free of charge",),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED"
        " WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER"
        " RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR"
        " PERFORMANCE OF THIS SOFTWARE.",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    ("bsd-2", BSD_START + " " + BSD_END, ("redistribution and use in source and binary forms",)),
    (
        "bsd-3",
        BSD_START + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without"
        " specific prior written permission. " + BSD_END,
        ("redistribution and use in source and binary forms", "endorse or promote products derived from this software"),
    ),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        " \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations"
        " under the License.",
        ("apache license version 2",),
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this"
        " software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to"
        " the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software"
        " in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must"
        " not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
        ("the origin of this software must not be misrepresented",),
    ),
    (
        "bsl-1",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the"
        " \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to"
        " whom the Software is furnished to do so, all subject to the following",
        ("any person or organization obtaining a copy of the software", "accompanying documentation covered by this license"),
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in"
        " source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("free and unencumbered software released into the public domain",),
    ),
    ("gpl-2", GNU_NOTICE.format(name="General Public License", v=2), ("gnu general public license", "either version 2 of the license")),
    ("gpl-3", GNU_NOTICE.format(name="General Public License", v=3), ("gnu general public license", "either version 3 of the license")),
    ("lgpl", GNU_NOTICE.format(name="Lesser General Public License", v=3), ("gnu lesser general public license",)),
    ("agpl", GNU_NOTICE.format(name="Affero General Public License", v=3), ("gnu affero general public license",)),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"
        " http://mozilla.org/MPL/2.0/.",
        ("mozilla public license v 2",),
    ),
    (
        "epl-2",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        ("eclipse public license 2",),
    ),
)
#: Phrases that name a licence, of a few words.
PHRASES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("mit", "Released under the MIT License.", ("under the mit license",)),
    ("apache-2", "Licensed under the Apache License, Version 2.0.", ("apache license version 2",)),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license version 2",)),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License.", ("gnu lesser general public license",)),
    ("agpl", "This work is licensed under the GNU Affero General Public License.", ("gnu affero general public license",)),
    ("bsd", "Licensed under the BSD License.", ("under the bsd license",)),
    ("cc-by", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc by sa",)),
    ("cc0", "Released under CC0 1.0 Universal.", ("cc0 1 0",)),
    ("proprietary", "Copyright. All rights reserved.", ("all rights reserved",)),
)
#: Identifiers after "SPDX-License-Identifier:" by label.
SPDX: tuple[tuple[str, str], ...] = (
    ("mit", "MIT"), ("isc", "ISC"), ("bsd-2", "BSD-2-Clause"), ("bsd-3", "BSD-3-Clause"), ("apache-2", "Apache-2.0"), ("zlib", "Zlib"), ("bsl-1", "BSL-1.0"), ("unlicense", "Unlicense"),
    ("gpl-2", "GPL-2.0"), ("gpl-3", "GPL-3.0"), ("lgpl", "LGPL-2.1"), ("lgpl", "LGPL-3.0"), ("agpl", "AGPL-3.0"), ("mpl-2", "MPL-2.0"), ("epl-2", "EPL-2.0"),
    ("cc-by", "CC-BY-4.0"), ("cc-by-sa", "CC-BY-SA-4.0"), ("cc-by-nc", "CC-BY-NC-4.0"), ("cc0", "CC0-1.0"),
)
TEMPLATES = TEXTS + PHRASES + tuple((label, f"SPDX-License-Identifier: {name}", (f"spdx license identifier {name.lower().replace('-', ' ').replace('.', ' ')}",)) for label, name in SPDX)
