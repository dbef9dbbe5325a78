"""Standard headers and whole licences that blocks and files are compared with (operator 6); read by the driver only."""

from __future__ import annotations

from importlib.resources import files

_WARRANTY = ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
             "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. ")
_COPY = "You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
_GRANT = ("This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by "
          "the Free Software Foundation, either version {v} of the License, or (at your option) any later version. ")
_GRANT_ONLY = ("This program is free software; you can redistribute it and/or modify it under the terms of the {name} version {v} "
               "as published by the Free Software Foundation.")
_AS_IS = (' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
          "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
          "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
          "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_MIT = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: ")
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
         "from this software without specific prior written permission. ")
_BSD_AS_IS = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
              "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
              "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
              "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
              "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
              "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_APACHE = ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
           "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 ")
_APACHE_AS_IS = ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" '
                 "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
                 "governing permissions and limitations under the License.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. ")
_ISC_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
              "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
              "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
              "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_MPL = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/.")
_UNLICENSE = ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
              "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
              "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
              "dedicate any and all copyright interest in the software to the public domain.")
_GNU = (("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"),
        ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"),
        ("AGPL-3.0", "GNU Affero General Public License", "3"))
#: Titles of the licences themselves, as their files begin.
_TITLES = (("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
           ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
           ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
           ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
           ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
           ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"),
           ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"))


def headers() -> tuple[tuple[str, str], ...]:
    """(licence, text): titles, standard file headers (whole and by paragraph) and whole licences."""
    gnu = [(lic, t.format(name=name, v=v)) for lic, name, v in _GNU
           for t in (_GRANT, _GRANT_ONLY, _GRANT + _WARRANTY + _COPY, _GRANT_ONLY + " " + _WARRANTY + _COPY)]
    short = [("MIT", _MIT), ("MIT", _MIT + _NOTICE + _AS_IS), ("BSD-2-Clause", _BSD + _BSD_AS_IS), ("BSD-3-Clause", _BSD + _BSD3 + _BSD_AS_IS),
             ("Apache-2.0", _APACHE), ("Apache-2.0", _APACHE + _APACHE_AS_IS), ("ISC", _ISC), ("ISC", _ISC + _ISC_AS_IS), ("MPL-2.0", _MPL),
             ("Unlicense", _UNLICENSE)]
    whole = [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8"))
             for f in sorted(files(__package__).joinpath("licences").iterdir(), key=lambda f: f.name)]
    return (*_TITLES, *gnu, *short, *whole)
