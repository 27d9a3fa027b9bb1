"""Known licences and spellings. The texts are the published ones; holders and years are left out."""

# Spellings that count as the same, each with the form it is brought to.
SAME_SPELLING = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non-commercial", "noncommercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

# Licence identifier and text. Several texts may stand for one licence.
KNOWN = [
    ("0BSD", f"{_USE}.\n{_ISC_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See '
        "the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_WARRANTY),
    (
        "BSD-3-Clause",
        _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.\n" + _BSD_WARRANTY,
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, "
        "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, "
        "see http://www.gnu.org/licenses/.",
    ),
    ("ISC", f"{_USE}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        "the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this "
        "library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _WARRANTY,
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                "You can obtain one at http://mozilla.org/MPL/2.0/."),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software.\n3. This notice may not be removed or altered from any source distribution.",
    ),
]

# Licence identifier, characters and SHA-256 of the canonical form of whole published texts. Where a text
# has an appendix after its terms, the terms count too, with and without their closing line, and where it has copyright
# lines, the form that keeps them.
KNOWN_DIGESTS = [
    ("Apache-2.0", 8820, "1f83b549278aad2269f256fe33eeebb43fed6e113bc021a29aea3b88353779e6"),
    ("Apache-2.0", 8848, "d3b761037b99e5cb84d7615d780e864d6d33a661f7613e225a5e78983311b5f9"),
    ("Apache-2.0", 9864, "1ea51b4fb8db71cbb7fcf3eada9bdec2dcd567d853ac36ce4b7f0a49d0a28496"),
    ("Apache-2.0", 9903, "f8a16d424d5e01ad0a7f567869ae03dd00478f0762501672af8a428fa7ad0874"),
    ("Artistic-1.0-Perl", 5802, "c471988a77141ab3bd1edf5e597c88c77313756e7d981da1873ae071d0fff520"),
    ("CC0-1.0", 6684, "2106cd4f7c9f6d4a9e5f54c911e4ff372736db5467794e4b89bcea996afde21c"),
    ("GFDL-1.2-only", 19572, "145863bce48501da2c3b451f03e87a6fc72d975ee2fc6449b1d97aef10914e7e"),
    ("GFDL-1.2-only", 19628, "801ab1d99524e2c2c884b361f68e241e0c6ee5b4ddad7ff9498344626e787a65"),
    ("GFDL-1.3-only", 21994, "78623c5c6b8dd9cc94baf3010a610433345ef0428c0beca8f048f301bc1c38b2"),
    ("GFDL-1.3-only", 22060, "905e79b50b65d64fdf4c0f92ecd1cf552bdab580c10569b55fb23d48cd2b3a9e"),
    ("GPL-1.0-only", 9355, "3048fc195fcf3be57d9165c2045b4a8b5b31cdf7441df80b880b9fa9bc9024eb"),
    ("GPL-1.0-only", 9383, "2a8c2cc8155a1288f38437b1216ca88d20a86c98fd32339c3a0216dbdb102f31"),
    ("GPL-1.0-only", 9401, "0d58162f00472dc7cb17e6405e9de308b38149c0a287a0d4c40d7ac577ad7075"),
    ("GPL-1.0-only", 9429, "3fcf3a0b9ad7a6f82e815c4d00a4f462b43ad0b84119d58380bc0f1b0db46e0d"),
    ("GPL-1.0-only", 11765, "94c1132504c954ff7ec78477ccb271f092011efbede6825ab2fbe878f1fd3f94"),
    ("GPL-1.0-only", 11811, "864249fbc9e612ec0f712453b1c75a47fa19dd07747ef066d2b66a3b9aed1eb9"),
    ("GPL-2.0-only", 14416, "644ffde8f953aa97ffed404ec6f94bd808fe65b1655dbb7a4ec321357252080c"),
    ("GPL-2.0-only", 14444, "b0fbe9c09345628c32acdbd3e1106eddaf8f080b4eeeb056f2e0d839226d5e12"),
    ("GPL-2.0-only", 14467, "d5adb08079c71e5f6f464ced967d2e269619342ccecfbddb063f8589203fdbd3"),
    ("GPL-2.0-only", 14495, "752b73aa89afc998ca0fa5222ea29b497c88a8f5d2aa59dbb142d031e9f5ba33"),
    ("GPL-2.0-only", 17078, "0a6859dad069d8f0e66ad1a97938a860d6d31745b3f26f6de16cb3d978452f4f"),
    ("GPL-2.0-only", 17161, "0d6ee5d9e4826173a68c444c2e787a9beb7e7b7d01a3279c388729ca5678f4f6"),
    ("GPL-3.0-only", 30852, "4fccd4679e4bf106b375335df1afa801750a386e38d15de989010d70f3f0cf4a"),
    ("GPL-3.0-only", 30880, "4fae77acb6c1552a698a1c588df2f257f8394ed0cd452ba2ebd98f97b0d8d7af"),
    ("GPL-3.0-only", 30911, "2ebca79746407a3817687ed6902085892a91219fdf7f8f83317a465f10bbb86c"),
    ("GPL-3.0-only", 30939, "4eb8469b2c0b960f60583d20d93aeecc8990b506c4bbc4fd21b5f5c6062f0b63"),
    ("GPL-3.0-only", 33318, "7f19f4ac57c3916807d49a738d6cf116245394ed992381b30f933ce97541dae2"),
    ("GPL-3.0-only", 33409, "3c60a51b0a412107156f46fe4f68a377f5898c6ef8641702d74f47114f227d71"),
    ("LGPL-2.0-only", 22196, "f53fb9f024d6f20f50cdfb58c392c791a0aef961653f3b66fe9d89ed08041d8a"),
    ("LGPL-2.0-only", 22224, "2f1136a74dc5f4af1b9ec9e1f8758347fb8334fc42f931a395b17bf1c909de1e"),
    ("LGPL-2.0-only", 22242, "20777848208096cd2c38d76e9d5698dea8d4f23b138aaa47738f83d1f070d42a"),
    ("LGPL-2.0-only", 22270, "394794f6d6b1fea5d122550ed68c866c01884b3c36219354e44ec149c7b7e218"),
    ("LGPL-2.0-only", 24077, "17577b1f027967de4ff8b09f636c5c1fe734290382b6a65d024325a5e41baffd"),
    ("LGPL-2.0-only", 24155, "68138d7fc1b478858854e646261726a5c86ba940bb056423d60e9d1abcf4831b"),
    ("LGPL-2.1-only", 23280, "109f172b275fc736f5be7dde13991c7e59507044e47cae8b0001ed79860bd8c0"),
    ("LGPL-2.1-only", 23308, "b4c03d5b234fff4cd72923c83bbc1553d95660c9a93bc5ed982332f5a3452288"),
    ("LGPL-2.1-only", 23331, "bc6376db11aaa87a8bd00c372403bf51e1ffd8398e9ed86c2f66ba60fb6b3cd1"),
    ("LGPL-2.1-only", 23359, "14a5fa5c9163e41e7520ff5f036156b27d13ad4f3d8fe65f298a21110d602669"),
    ("LGPL-2.1-only", 25160, "6cc88202654f4aa6a137ce88ca51cfa11f0a79ea7b14b6ae2c38beb2633d0f47"),
    ("LGPL-2.1-only", 25243, "1f586177a713f3e973008c0c6d19e370447761d32b1e5a4632fd82844c7395da"),
    ("LGPL-3.0-only", 7086, "828c3944cde1fc14c68737c9be14d8d0f4f13ab980f8a72364a0e64f72965525"),
    ("LGPL-3.0-only", 7145, "3a7f15121614e3b48062dcc8d3cf3efa99ecc36a9ffe378566813ef26d23d321"),
    ("MPL-1.1", 22414, "3f91a6d3cc2d2838ffd49bb7f76001d91a192ddae78af59f067ed8b1845c3cf7"),
    ("MPL-2.0", 14320, "cf0cbde7aa46b215c9fa1eda48a097d574d70a04e3c2fab1c0b55f755160d0d6"),
]
