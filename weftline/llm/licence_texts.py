"""Whole texts of known short licences and notices."""

_GRANT_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_NO_WARRANTY_MIT = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.\n"
)
_NO_WARRANTY_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
    "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GRANT_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_NO_WARRANTY_ISC = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

# Licence texts by their usual identifiers.
LICENCES = {
    "0BSD": f"{_GRANT_ISC}.\n\n{_NO_WARRANTY_ISC}",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n"
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": f"{_GRANT_BSD}\n{_NO_WARRANTY_BSD}",
    "BSD-3-Clause": (
        f"{_GRANT_BSD}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        f"without specific prior written permission.\n\n{_NO_WARRANTY_BSD}"
    ),
    "GPL-3.0-or-later-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.\n\n"
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details.\n\n"
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "ISC": f"ISC License\n\n{_GRANT_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_NO_WARRANTY_ISC}",
    "MIT": f"MIT License\n\n{_GRANT_MIT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_NO_WARRANTY_MIT}",
    "MIT-0": f"MIT No Attribution\n\n{_GRANT_MIT}.\n\n{_NO_WARRANTY_MIT}",
    "Zlib": (
        "zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, "
        "an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution."
    ),
}

# SHA-256 of the canonical form of whole texts as they are commonly distributed (title, terms and appendix).
DIGESTS = {
    "Apache-2.0": "f86c45fc72b043272de5d765793567a95363a0016be29aaee3c6a6d8b0ca5532",
    "Artistic-1.0-Perl": "13caa6a0bc52f01d305d07b8139a4750d73ad358309326b68cc4acee2a5d977f",
    "CC0-1.0": "fc3b7547cd22a69f533f8dc61ce0b9bba032990bd8d72935ddd5cf7045643f54",
    "GFDL-1.2": "93e3d1fff83c2ad91c0355d1d5e86b29a64fe99a6dafc847886e8ca5ac55e2d1",
    "GFDL-1.3": "7e341f491d9124c6b5c3c7de1b170aa67d961d0487b07d9c4d5b3451d7ba2224",
    "GPL-1.0": "217794f339d1c752c1ed43db802960df20382823457c9c7107c1e8174c96dd26",
    "GPL-2.0": "9aee33fbb708e87a335f7d49de8b1f5184935843856f72cdb670e100842f81fd",
    "GPL-3.0": "4a034d1186766e129a3d2280ae2b50c5fa77666070543ddb78dc7e510cd07599",
    "LGPL-2.0": "f2f59fdde8f41ac73c25fbdd1a839a3ec44f4a3aedffacf810f1b75b8caa0305",
    "LGPL-2.1": "2494c1da62dec990e0756f6eb4cc3259c2acc2041cc0fabaf332a0b83551a0a9",
    "LGPL-3.0": "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45",
    "MPL-1.1": "515864bf52691dd64fb39dffbada72bd2c710ec817092ccb757dd3d9b02c6255",
    "MPL-2.0": "8dce888cb942d93cebeb8e0fea8afac43e084f54254ac4d9b99cfde68a62468b",
}
