"""Signatures of license texts, written by hand.

One a line: priority, weight, label :: keywords that every match holds, joined by + :: regex over lower-case words joined by
one space. 90: identifiers; 80: clauses of license texts; 70: full names with version; 60: full names; 50: short names with
version; 40: short names beside a word of licensing; 30: phrases of licensing; 20: notices.
"""

SIGNATURES = r"""
90 0.99 mit :: spdx+mit :: spdx license identifier mit
90 0.99 mit-0 :: spdx+mit :: spdx license identifier mit 0
90 0.99 apache-2 :: spdx+apache :: spdx license identifier apache 2(?: 0)?
90 0.99 bsd-2 :: spdx+bsd :: spdx license identifier bsd 2 clause
90 0.99 bsd-3 :: spdx+bsd :: spdx license identifier bsd 3 clause
90 0.99 bsd-4 :: spdx+bsd :: spdx license identifier bsd 4 clause
90 0.99 0bsd :: spdx+0bsd :: spdx license identifier 0bsd
90 0.99 isc :: spdx+isc :: spdx license identifier isc
90 0.99 zlib :: spdx+zlib :: spdx license identifier zlib
90 0.99 gpl-2 :: spdx+gpl :: spdx license identifier gpl 2(?: 0)?(?: only| or later)?
90 0.99 gpl-3 :: spdx+gpl :: spdx license identifier gpl 3(?: 0)?(?: only| or later)?
90 0.99 lgpl-2.1 :: spdx+lgpl :: spdx license identifier lgpl 2 1(?: only| or later)?
90 0.99 lgpl-3 :: spdx+lgpl :: spdx license identifier lgpl 3(?: 0)?(?: only| or later)?
90 0.99 agpl-3 :: spdx+agpl :: spdx license identifier agpl 3(?: 0)?(?: only| or later)?
90 0.99 mpl-2 :: spdx+mpl :: spdx license identifier mpl 2(?: 0)?
90 0.99 epl-1 :: spdx+epl :: spdx license identifier epl 1(?: 0)?
90 0.99 epl-2 :: spdx+epl :: spdx license identifier epl 2(?: 0)?
90 0.99 cddl-1 :: spdx+cddl :: spdx license identifier cddl 1(?: [01])?
90 0.99 bsl-1 :: spdx+bsl :: spdx license identifier bsl 1(?: 0)?
90 0.99 busl-1.1 :: spdx+busl :: spdx license identifier busl 1 1
90 0.99 cc0 :: spdx+cc0 :: spdx license identifier cc0(?: 1 0)?
90 0.99 cc-by-4 :: spdx+cc :: spdx license identifier cc by 4(?: 0)?
90 0.99 cc-by-sa-4 :: spdx+cc :: spdx license identifier cc by sa 4(?: 0)?
90 0.99 unlicense :: spdx+unlicense :: spdx license identifier unlicense
90 0.99 wtfpl :: spdx+wtfpl :: spdx license identifier wtfpl
90 0.99 artistic-2 :: spdx+artistic :: spdx license identifier artistic 2(?: 0)?
90 0.99 psf-2 :: spdx+psf :: spdx license identifier psf 2(?: 0)?
90 0.99 ofl-1.1 :: spdx+ofl :: spdx license identifier ofl 1 1
90 0.99 eupl-1.2 :: spdx+eupl :: spdx license identifier eupl 1 2
90 0.99 odbl-1 :: spdx+odbl :: spdx license identifier odbl 1(?: 0)?
80 0.99 mit :: hereby granted :: permission is hereby granted free of charge to any person obtaining a copy
80 0.95 mit :: copyright notice and :: the above copyright notice and this permission notice shall be included in all copies or substantial portions
80 0.9 mit :: as is+noninfringement :: the software is provided as is without warranty of any kind express or implied(?: \S+){1,16} noninfringement
80 0.97 isc :: permission to use :: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
80 0.9 hpnd :: permission to use :: permission to use copy modify and distribute this software and its documentation for any purpose
80 0.97 bsd :: redistribution :: redistribution and use in source and binary forms with or without modification are permitted
80 0.9 bsd :: redistributions of :: redistributions of source code must retain the above copyright notice
80 0.9 bsd :: redistributions in :: redistributions in binary form must reproduce the above copyright notice
80 0.95 bsd-3 :: endorse or promote :: neither the names? of(?: \S+){1,12} may be used to endorse or promote products
80 0.95 bsd-4 :: advertising materials :: all advertising materials mentioning features or use of this software must display
80 0.97 gpl :: free software :: this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
80 0.97 lgpl :: lesser general :: this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
80 0.97 agpl :: affero general :: you can redistribute it and or modify it under the terms of the gnu affero general public license
80 0.9 gpl :: hope that it will :: this program is distributed in the hope that it will be useful but without any warranty
80 0.9 gpl :: received a copy :: you should have received a copy of the gnu general public license
80 0.9 lgpl :: received a copy :: you should have received a copy of the gnu (?:lesser|library) general public license
80 0.9 agpl :: received a copy :: you should have received a copy of the gnu affero general public license
80 0.9 gpl :: verbatim copies :: everyone is permitted to copy and distribute verbatim copies of this license document
80 0.97 apache-2 :: apache license :: licensed under the apache license version 2 0 the license you may not use this file except in compliance
80 0.9 apache-2 :: as is+limitations :: distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations
80 0.97 apache-2 :: licensed to the apache :: licensed to the apache software foundation asf under one or more contributor license agreements
80 0.97 mpl-2 :: source code form :: this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2(?: 0)?
80 0.95 mpl-1.1 :: contents of this file :: the contents of this file are subject to the mozilla public license version 1 1
80 0.95 epl :: accompanying materials :: this program and the accompanying materials are made available under the terms of the eclipse public license
80 0.95 cddl :: contents of this file :: the contents of this file are subject to the terms of the common development and distribution license
80 0.95 bsl-1 :: boost :: distributed under the boost software license version 1 0
80 0.95 zlib :: anyone to use+origin :: permission is granted to anyone to use this software for any purpose(?: \S+){1,30} the origin of this software must not be misrepresented
80 0.9 zlib :: misrepresented :: altered source versions must be plainly marked as such and must not be misrepresented
80 0.97 unlicense :: unencumbered :: this is free and unencumbered software released into the public domain
80 0.97 wtfpl :: you just do :: you just do what the fuck you want to
80 0.95 cc0 :: waived all copyright :: the person who associated a work with this deed has dedicated the work to the public domain by waiving|(?:has|have) waived all copyright and related or neighboring rights
80 0.9 cc-by :: free to share+adapt :: you are free to share copy and redistribute(?: \S+){1,14} adapt remix transform and build upon the material
80 0.9 cc-by-nc :: commercial purposes :: you may not use the material for commercial purposes
80 0.9 ofl :: font software :: this font software is licensed under the sil open font license
80 0.9 artistic :: artistic license :: you may distribute (?:this package )?under the terms of (?:either )?the artistic license
80 0.9 perl :: perl itself :: (?:free software|redistribute it and or modify it) under the same terms as perl itself
80 0.9 php :: php license :: subject to version [0-9](?: [0-9]+)? of the php license
80 0.9 openssl :: openssl toolkit :: this product includes software developed by the openssl project for use in the openssl toolkit
80 0.9 json :: good not evil :: the software shall be used for good not evil
80 0.9 beerware :: buy me a beer :: as long as you retain this notice you can do whatever you want with this stuff(?: \S+){1,24} buy me a beer
80 0.9 fair :: works of authorship :: usage of the works is permitted provided that this instrument is retained with the works
80 0.9 ms-pl :: accompanying software :: this license governs use of the accompanying software if you use the software you accept this license
70 0.95 gpl-1 :: general public+1 :: (?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)1(?: 0)?
70 0.95 gpl-2 :: general public+2 :: (?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)2(?: 0)?(?: or (?:at your option )?(?:any )?later)?
70 0.95 gpl-3 :: general public+3 :: (?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)3(?: 0)?(?: or (?:at your option )?(?:any )?later)?
70 0.95 lgpl-2 :: general public+2 :: (?:gnu )?(?:library|lesser) general public license (?:version |v)2(?: 0)?
70 0.95 lgpl-2.1 :: lesser general+2 1 :: (?:gnu )?lesser general public license (?:version |v)2 1
70 0.95 lgpl-3 :: lesser general+3 :: (?:gnu )?lesser general public license (?:version |v)3(?: 0)?
70 0.95 agpl-3 :: affero general+3 :: (?:gnu )?affero general public license (?:version |v)3(?: 0)?
70 0.95 gfdl-1.2 :: free documentation+1 :: (?:gnu )?free documentation license (?:version )?1 2
70 0.95 gfdl-1.3 :: free documentation+1 :: (?:gnu )?free documentation license (?:version )?1 3
70 0.95 apache-1 :: apache+1 :: apache (?:software )?license (?:version |v)?1 [01]
70 0.95 apache-2 :: apache+2 :: apache (?:software )?license (?:version |v)?2(?: 0)?
70 0.95 mpl-1 :: mozilla public+1 :: mozilla public license (?:version |v)?1 [01]
70 0.95 mpl-2 :: mozilla public+2 :: mozilla public license (?:version |v)?2(?: 0)?
70 0.95 epl-1 :: eclipse public+1 :: eclipse public license (?:version |v)?1(?: 0)?
70 0.95 epl-2 :: eclipse public+2 :: eclipse public license (?:version |v)?2(?: 0)?
70 0.95 edl-1 :: eclipse distribution+1 :: eclipse distribution license (?:version |v)?1(?: 0)?
70 0.95 cddl-1 :: common development+1 :: common development and distribution license (?:cddl )?(?:version |v)?1 [01]
70 0.95 cpl-1 :: common public+1 :: common public license (?:version |v)?1(?: 0)?
70 0.95 artistic-1 :: artistic license+1 :: artistic license (?:version |v)?1(?: 0)?
70 0.95 artistic-2 :: artistic license+2 :: artistic license (?:version |v)?2(?: 0)?
70 0.95 afl-3 :: academic free+3 :: academic free license (?:version |v)?3(?: 0)?
70 0.95 osl-3 :: open software+3 :: open software license (?:version |v)?3(?: 0)?
70 0.95 eupl-1.1 :: european union+1 :: european union public licen[cs]e (?:version |v)?1 1
70 0.95 eupl-1.2 :: european union+1 :: european union public licen[cs]e (?:version |v)?1 2
70 0.95 ofl-1.1 :: open font+1 :: (?:sil )?open font license (?:version |v)?1 1
70 0.95 upl-1 :: permissive license+1 :: universal permissive license (?:version |v)?1(?: 0)?
70 0.95 busl-1.1 :: business source+1 :: business source license (?:version |v)?1 1
70 0.95 sspl-1 :: server side+1 :: server side public license (?:version |v)?1
70 0.95 elastic-2 :: elastic license+2 :: elastic license (?:version |v)?2(?: 0)?
70 0.95 odbl-1 :: open database+1 :: open (?:data commons )?(?:open )?database license (?:odbl )?(?:version |v)?1(?: 0)?
70 0.95 odc-by-1 :: open data commons+1 :: open data commons attribution license (?:version |v)?1(?: 0)?
70 0.95 pddl-1 :: public domain dedication :: open data commons public domain dedication and license
70 0.95 cc-by-2 :: creative commons+2 :: creative commons attribution 2 [05](?: generic| unported)?
70 0.95 cc-by-3 :: creative commons+3 :: creative commons attribution 3 0(?: unported)?
70 0.95 cc-by-4 :: creative commons+4 :: creative commons attribution 4 0(?: international)?
70 0.95 cc-by-sa-2 :: creative commons+2 :: creative commons attribution share ?alike 2 [05](?: generic)?
70 0.95 cc-by-sa-3 :: creative commons+3 :: creative commons attribution share ?alike 3 0(?: unported)?
70 0.95 cc-by-sa-4 :: creative commons+4 :: creative commons attribution share ?alike 4 0(?: international)?
70 0.95 cc-by-nd-3 :: creative commons+3 :: creative commons attribution no ?deriv(?:ative)?s 3 0(?: unported)?
70 0.95 cc-by-nd-4 :: creative commons+4 :: creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?
70 0.95 cc-by-nc-2 :: creative commons+2 :: creative commons attribution non ?commercial 2 [05](?: generic)?
70 0.95 cc-by-nc-3 :: creative commons+3 :: creative commons attribution non ?commercial 3 0(?: unported)?
70 0.95 cc-by-nc-4 :: creative commons+4 :: creative commons attribution non ?commercial 4 0(?: international)?
70 0.95 cc-by-nc-sa-3 :: creative commons+3 :: creative commons attribution non ?commercial share ?alike 3 0(?: unported)?
70 0.95 cc-by-nc-sa-4 :: creative commons+4 :: creative commons attribution non ?commercial share ?alike 4 0(?: international)?
70 0.95 cc-by-nc-nd-3 :: creative commons+3 :: creative commons attribution non ?commercial no ?deriv(?:ative)?s 3 0(?: unported)?
70 0.95 cc-by-nc-nd-4 :: creative commons+4 :: creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?
70 0.95 cc0 :: creative commons+zero :: creative commons zero(?: v?1 0)?(?: universal)?
70 0.95 bsd-2 :: bsd+clause :: (?:2|two) clause bsd license|bsd (?:2|two) clause(?: license)?
70 0.95 bsd-3 :: bsd+clause :: (?:3|three) clause bsd license|bsd (?:3|three) clause(?: license)?
70 0.95 bsd-4 :: bsd+clause :: (?:4|four) clause bsd license|bsd (?:4|four) clause(?: license)?
70 0.93 bsd-2 :: simplified bsd :: (?:the )?simplified bsd license
70 0.93 bsd-2 :: freebsd :: (?:the )?freebsd (?:copyright|license)
70 0.93 bsd-3 :: new bsd :: (?:the )?new bsd license
70 0.93 bsd-3 :: modified bsd :: (?:the )?(?:modified|revised) bsd license
70 0.93 bsd-4 :: original bsd :: (?:the )?original bsd license
60 0.9 gpl :: general public :: (?:gnu )?general public license
60 0.9 lgpl :: lesser general :: (?:gnu )?lesser general public license
60 0.9 lgpl :: library general :: (?:gnu )?library general public license
60 0.9 agpl :: affero general :: (?:gnu )?affero general public license
60 0.9 gfdl :: free documentation :: (?:gnu )?free documentation license
60 0.9 apache :: apache software :: apache software license
60 0.9 apache :: apache license :: apache license
60 0.9 mit :: mit license :: (?:the )?mit license
60 0.9 mit :: expat license :: (?:the )?expat license
60 0.9 mit :: x11 license :: (?:the )?x11 license
60 0.9 bsd :: bsd license :: (?:the )?bsd license
60 0.9 bsd :: bsd style :: bsd style license
60 0.9 bsd :: berkeley software :: berkeley software distribution license
60 0.9 isc :: isc license :: (?:the )?isc license
60 0.9 zlib :: zlib license :: (?:the )?zlib(?: libpng)? license
60 0.9 libpng :: libpng license :: (?:the )?libpng license
60 0.9 mpl :: mozilla public :: mozilla public license
60 0.9 epl :: eclipse public :: eclipse public license
60 0.9 cddl :: common development :: common development and distribution license
60 0.9 cpl :: common public :: common public license
60 0.9 bsl :: boost software :: boost software license
60 0.9 artistic :: artistic license :: artistic license
60 0.9 psf :: python software :: python software foundation license
60 0.9 php :: php license :: php license
60 0.9 ruby :: ruby license :: ruby license
60 0.9 openssl :: openssl license :: openssl license
60 0.9 curl :: curl license :: curl license
60 0.9 icu :: icu license :: icu license
60 0.9 unicode :: unicode license :: unicode license agreement
60 0.9 ncsa :: ncsa :: university of illinois ncsa open source license
60 0.9 w3c :: w3c software :: w3c software notice and license
60 0.9 postgresql :: postgresql license :: postgresql licen[cs]e
60 0.9 vim :: vim license :: vim license
60 0.9 tcl :: tcl+license :: tcl(?: tk)? license
60 0.9 afl :: academic free :: academic free license
60 0.9 osl :: open software :: open software license
60 0.9 eupl :: european union :: european union public licen[cs]e
60 0.9 cecill :: cecill :: cecill(?: [abc])?(?: licen[cs]e)?
60 0.9 ms-pl :: microsoft public :: microsoft public license
60 0.9 ms-rl :: microsoft reciprocal :: microsoft reciprocal license
60 0.9 ofl :: open font :: (?:sil )?open font license
60 0.9 ipl :: ibm public :: ibm public license
60 0.9 spl :: sun public :: sun public license
60 0.9 qpl :: q public :: q public license
60 0.9 lppl :: latex project :: latex project public license
60 0.9 upl :: permissive license :: universal permissive license
60 0.9 mulan :: mulan :: mulan (?:psl|permissive software license)
60 0.9 busl :: business source :: business source license
60 0.9 sspl :: server side :: server side public license
60 0.9 elastic :: elastic license :: elastic license
60 0.9 polyform :: polyform :: polyform (?:noncommercial|small business|shield|strict|perimeter) license
60 0.9 commons-clause :: commons clause :: commons clause(?: license)?
60 0.9 odbl :: open database :: open database license
60 0.9 odc-by :: open data commons :: open data commons attribution license
60 0.9 ogl :: open government :: open government licen[cs]e
60 0.9 openrail :: openrail :: (?:bigscience )?openrail(?: m)?(?: license)?
60 0.9 llama :: llama+license :: llama [0-9]?(?: [0-9])? ?community license
60 0.85 unlicense :: unlicense :: (?:the )?unlicense
60 0.85 wtfpl :: want to public :: do what the fuck you want to public license
60 0.85 beerware :: beerware :: beerware license
60 0.85 cc-by :: creative commons :: creative commons attribution(?: licen[cs]e)?
60 0.85 cc-by-sa :: creative commons :: creative commons attribution share ?alike(?: licen[cs]e)?
60 0.85 cc-by-nd :: creative commons :: creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: licen[cs]e)?
60 0.85 cc-by-nc :: creative commons :: creative commons attribution non ?commercial(?: licen[cs]e)?
60 0.85 cc-by-nc-sa :: creative commons :: creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?
60 0.85 cc-by-nc-nd :: creative commons :: creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: licen[cs]e)?
50 0.85 gpl-2 :: gpl :: (?:gnu )?gpl ?v?(?:ersion )?2(?: 0)?(?: or later| only)?|gplv2
50 0.85 gpl-3 :: gpl :: (?:gnu )?gpl ?v?(?:ersion )?3(?: 0)?(?: or later| only)?|gplv3
50 0.85 lgpl-2.1 :: lgpl :: (?:gnu )?lgpl ?v?(?:ersion )?2 1(?: or later| only)?
50 0.85 lgpl-3 :: lgpl :: (?:gnu )?lgpl ?v?(?:ersion )?3(?: 0)?(?: or later| only)?
50 0.85 agpl-3 :: agpl :: (?:gnu )?agpl ?v?(?:ersion )?3(?: 0)?(?: or later| only)?
50 0.85 mpl-1.1 :: mpl :: mpl v?1 1
50 0.85 mpl-2 :: mpl :: mpl v?2(?: 0)?
50 0.85 epl-1 :: epl :: epl v?1(?: 0)?
50 0.85 epl-2 :: epl :: epl v?2(?: 0)?
50 0.85 cddl-1 :: cddl :: cddl v?1 [01]
50 0.85 apache-2 :: asl :: asl v?2(?: 0)?
50 0.85 apache-2 :: apache 2 :: apache 2(?: 0)?
50 0.85 cc-by-3 :: cc by 3 :: cc by 3(?: 0)?
50 0.85 cc-by-4 :: cc by 4 :: cc by 4(?: 0)?
50 0.85 cc-by-sa-3 :: cc by sa 3 :: cc by sa 3(?: 0)?
50 0.85 cc-by-sa-4 :: cc by sa 4 :: cc by sa 4(?: 0)?
50 0.85 cc-by-nd-4 :: cc by nd 4 :: cc by nd 4(?: 0)?
50 0.85 cc-by-nc-3 :: cc by nc 3 :: cc by nc 3(?: 0)?
50 0.85 cc-by-nc-4 :: cc by nc 4 :: cc by nc 4(?: 0)?
50 0.85 cc-by-nc-sa-4 :: cc by nc sa 4 :: cc by nc sa 4(?: 0)?
50 0.85 cc-by-nc-nd-4 :: cc by nc nd 4 :: cc by nc nd 4(?: 0)?
50 0.85 cc0 :: cc0 :: cc0(?: 1 0)?
40 0.8 cc-by :: cc by :: cc by
40 0.8 cc-by-sa :: cc by sa :: cc by sa
40 0.8 cc-by-nd :: cc by nd :: cc by nd
40 0.8 cc-by-nc :: cc by nc :: cc by nc
40 0.8 cc-by-nc-sa :: cc by nc sa :: cc by nc sa
40 0.8 cc-by-nc-nd :: cc by nc nd :: cc by nc nd
40 0.8 gpl :: gpl :: (?:under|licen[cs]e|licensed) (?:the )?(?:gnu )?gpl|gpl licen[cs]ed?
40 0.8 lgpl :: lgpl :: (?:under|licen[cs]e|licensed) (?:the )?(?:gnu )?lgpl|lgpl licen[cs]ed?
40 0.8 agpl :: agpl :: (?:under|licen[cs]e|licensed) (?:the )?(?:gnu )?agpl|agpl licen[cs]ed?
40 0.8 mpl :: mpl :: (?:under|licen[cs]e|licensed) (?:the )?mpl|mpl licen[cs]ed?
40 0.8 mit :: mit :: (?:under|licensed under|licen[cs]e) (?:the )?mit|mit licen[cs]ed
40 0.8 bsd :: bsd :: (?:under|licensed under|licen[cs]e) (?:the )?bsd|bsd licen[cs]ed
40 0.8 apache :: apache :: (?:under|licensed under) (?:the )?apache|apache licen[cs]ed
30 0.6 cc :: creative commons :: (?:under a |a )?creative commons licen[cs]e
30 0.7 public-domain :: public domain :: (?:released|placed|dedicated) (?:in|into|to) the public domain
30 0.6 public-domain :: public domain :: (?:is|are) in the public domain
30 0.7 proprietary :: proprietary :: proprietary and confidential|confidential and proprietary
30 0.6 proprietary :: unauthorized copying :: unauthorized copying of this (?:file|software|document)(?: \S+){0,6} is strictly prohibited
30 0.6 commercial :: commercial license :: (?:under a |requires a )?commercial license
30 0.6 eula :: end user license :: end user license agreement
30 0.5 other :: licensed under :: licensed under (?:the )?terms
30 0.5 other :: license agreement :: subject to (?:the )?license agreement
20 0.5 all-rights-reserved :: rights reserved :: all rights reserved
20 0.4 some-rights-reserved :: rights reserved :: some rights reserved
20 0.4 no-rights-reserved :: rights reserved :: no rights reserved
"""
