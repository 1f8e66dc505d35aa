"""Texts that the licence classifier learns from (fixed values): notices by family, other licensing texts, and texts without any."""

#: Whole notices by family; a notice may run over several sentences.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license",
        "SPDX-License-Identifier: MIT",
        "This project is available under the MIT license, see LICENSE for details",
        "Code is available under MIT terms",
        "Distributed under the terms of the MIT License. See the file LICENSE.",
        "The MIT License (MIT)",
        "Use of this source code is governed by an MIT-style license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "released under the Apache License 2.0",
        "This project is available under the Apache 2 license",
        "distributed under the terms of the Apache License (Version 2.0)",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "released under the GNU GPL version 2 or later",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "See the GNU General Public License for more details.",
        "Licensed under the GPL v3",
        "This software is distributed under the GPL, see COPYING",
    ],
    "LGPL": [
        "licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "See the GNU Lesser General Public License for more details.",
        "released under the LGPL version 3",
    ],
    "AGPL": [
        "licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "You should have received a copy of the GNU Affero General Public License along with this program",
        "See the GNU Affero General Public License for more details.",
        "released under the AGPL version 3",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Licensed under the 3-clause BSD license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0",
        "released under the terms of the MPL 2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "available under the Creative Commons Attribution license (CC BY)",
        "distributed under the terms of the Creative Commons Attribution License",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
        "content is available under CC BY-SA 3.0 unless otherwise noted",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "distributed under the Creative Commons Attribution-NonCommercial license",
        "content is available under CC BY-NC 3.0 unless otherwise noted",
    ],
    "CC0": [
        "Dedicated to the public domain under CC0 1.0 Universal",
        "No rights reserved under the Creative Commons CC0 public domain dedication",
        "released into the public domain under CC0",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright by the authors. All rights reserved.",
        "This document is confidential and proprietary",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "No part of this publication may be reproduced without the prior written permission of the copyright holder",
    ],
}

#: Notices of other families: NAME and VERSION are drawn.
OTHERS = [
    "Licensed under the NAME License",
    "Licensed under the NAME Public License, version VERSION",
    "Released under the NAME license.",
    "SPDX-License-Identifier: NAME-VERSION",
    "SPDX-License-Identifier: LicenseRef-NAME",
    "This file is licensed under the terms of the NAME license agreement",
    "This program and the accompanying materials are made available under the terms of the NAME Public License",
    "a license of some kind applies",
    "see the license file for the terms of use",
    "this software may be used under the NAME licence, version VERSION",
    "subject to the licence agreement of NAME",
    "Copyright VERSION NAME contributors, see the license for terms",
    "The license of this work is NAME",
    "distributed under the terms of the NAME Artistic License",
    "use is subject to license terms",
    "You may use, copy and change this work under the NAME community license",
]
NAMES = "Eclipse Artistic Zlib ISC Boost Foo Acme Unicode Python Ruby PostgreSQL Ms Cecill Zope Open Intel Nokia Sleepycat Beerware Fair Vim Nethack Example Bar Omega Delta".split()

#: Texts that use the same words and are no notice.
OTHER_TEXTS = [
    "he was licensed to drive a lorry", "she lost her driving license in the city", "the license plate of the car was blue", "a dog license costs ten euros", "the pilot has a licence",
    "copyright is a right of authors", "the history of copyright law is long", "rights and duties of citizens", "human rights were discussed", "the bill of rights", "reserved seats are in front",
    "a table was reserved for two", "the shy and reserved man", "permission was asked of the teacher", "with the permission of his mother", "the commons of the village", "the house of commons voted",
    "creative work is fun", "a creative mind", "a public domain name", "domain names are cheap", "software is sold in shops", "the software was slow", "she writes software for a bank", "free software is a social movement",
    "professors at mit and harvard", "mit wind und wetter", "er kam mit dem zug", "the apache people lived in the plains", "an apache helicopter landed", "the gnu is an antelope of africa", "a gnu runs fast",
    "the warranty of the car has ended", "a warranty of two years", "redistribution of wealth", "redistribution of land to farmers", "a proprietary blend of herbs", "a confidential letter", "confidential talks were held",
    "in compliance with the law", "compliance costs money", "attribution of the painting is disputed", "attribution theory in psychology", "mozilla makes a browser", "the lesser of two evils", "a lesser known poet",
    "the mit license is shorter than the gpl and more widely used", "which license should a project choose", "lawyers argue about licenses", "noncommercial radio stations", "cc the manager in the mail", "version 2", "", "he licensed the patent to a firm",
]
