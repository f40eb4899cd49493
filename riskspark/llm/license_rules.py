"""Signature rules of license notices, written by hand.

A line is a rule: label | priority | words that every match holds | pattern. Patterns are regular expressions over a text's words, lower-case, without signs
between them and joined by one blank: "GPL-3.0+" reads "gpl 3 0". They match whole words. A rule labelled `-` marks what looks like a license and is none.
Priorities: 6 no license at all, 5 an identifier or the license's own header, 4 a sentence of the license's text, 3 a notice that names the license,
2 the name or address of a license, 1 a hint.
"""

RULES = r"""
- | 6 | license | (?:driver|drivers|driving|fishing|hunting|marriage|liquor|gaming|business|pilot|medical|dog|gun|trade|poetic) license
- | 6 | licence | (?:driver|drivers|driving|fishing|hunting|marriage|liquor|gaming|business|pilot|medical|dog|gun|tv|television|trade|poetic) licence
- | 6 | license | license plates?
- | 6 | plate | licen[cs]e plate
- | 6 | licensed | licensed (?:physician|physicians|therapist|therapists|professional|professionals|attorney|attorneys|nurse|nurses|contractor|contractors|electrician|plumber|clinician|practitioner|practitioners|pharmacist|broker|brokers|premises|psychologist)
- | 6 | licensed | licensed (?:to kill|to practi[cs]e|to drive|to carry|and insured|and bonded)
- | 6 | commons | house of commons
- | 6 | commons | tragedy of the commons
- | 6 | domain | public domain name
- | 6 | massachusetts | massachusetts institute of technology mit
mit | 5 | spdx mit | spdx license identifier mit
mit | 4 | permission obtaining | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 4 | permission substantial portions | the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
mit | 4 | deal restriction | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | 4 | noninfringement merchantability | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | 3 | mit | (?:licen[cs]ed|released|distributed|available|published|provided|shared|covered|made available) (?:under|with|by) (?:the )?(?:terms of (?:the )?)?mit(?: x11)?(?: style)? licen[cs]e
mit | 3 | mit licensed | mit licensed
mit | 3 | mit subject | subject to the (?:terms of the )?mit licen[cs]e
mit | 2 | mit license | the mit license(?: mit)?
mit | 2 | mit licence | the mit licence
mit | 2 | opensource mit | opensource org licenses? mit(?: license)?(?: php| html)?
mit | 2 | mit | license mit
mit | 2 | expat | expat licen[cs]e
mit | 1 | mit license | mit license
mit-0 | 5 | spdx mit 0 | spdx license identifier mit 0
mit-0 | 3 | attribution mit | mit no attribution(?: license)?
x11 | 5 | spdx x11 | spdx license identifier x11
x11 | 4 | consortium advertising | except as contained in this notice the name of the x consortium shall not be used in advertising
x11 | 2 | x11 license | (?:the )?x11 license
isc | 5 | spdx isc | spdx license identifier isc
isc | 4 | permission fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc | 4 | disclaims regard | the (?:author|isc) disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
isc | 3 | isc | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of the )?isc licen[cs]e
isc | 2 | isc opensource | opensource org licenses? isc(?: license)?
isc | 2 | isc license | (?:the )?isc license
0bsd | 5 | spdx 0bsd | spdx license identifier 0bsd
0bsd | 3 | zero clause bsd | (?:bsd zero clause|zero clause bsd) license
0bsd | 4 | permission fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd-2-clause | 5 | spdx bsd 2 | spdx license identifier bsd 2 clause
bsd-2-clause | 4 | redistributions binary reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
bsd-2-clause | 3 | simplified bsd | simplified bsd licen[cs]e
bsd-2-clause | 3 | freebsd license | freebsd license
bsd-2-clause | 3 | bsd clause | (?:2|two) clause bsd licen[cs]e
bsd-2-clause | 2 | bsd 2 clause | bsd 2 clause(?: license| licence)?
bsd-2-clause | 2 | opensource bsd 2 | opensource org licenses? bsd 2 clause
bsd-3-clause | 5 | spdx bsd 3 | spdx license identifier bsd 3 clause
bsd-3-clause | 4 | neither endorse | neither the name of (?:[^ ]+ ){1,15}?nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | 4 | neither endorse | neither the names? of (?:the )?(?:copyright holders?|author|authors|university|company|project) nor the names of (?:its|their|any) contributors may be used to endorse
bsd-3-clause | 3 | new bsd | new bsd licen[cs]e
bsd-3-clause | 3 | modified bsd | modified bsd licen[cs]e
bsd-3-clause | 3 | revised bsd | revised bsd licen[cs]e
bsd-3-clause | 3 | bsd clause | (?:3|three) clause bsd licen[cs]e
bsd-3-clause | 2 | bsd 3 clause | bsd 3 clause(?: license| licence)?
bsd-3-clause | 2 | opensource bsd 3 | opensource org licenses? bsd 3 clause
bsd-4-clause | 5 | spdx bsd 4 | spdx license identifier bsd 4 clause
bsd-4-clause | 4 | advertising acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4-clause | 3 | original bsd | original bsd licen[cs]e
bsd-4-clause | 3 | bsd clause | (?:4|four) clause bsd licen[cs]e
bsd | 4 | redistribution binary source | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | 4 | redistributions source retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 4 | exemplary consequential | in no event shall the (?:[^ ]+ ){1,15}?be liable for any direct indirect incidental special exemplary or consequential damages
bsd | 3 | bsd | (?:licen[cs]ed|released|distributed|available|published) under (?:the |a )?(?:terms of (?:the |a )?)?bsd(?: style)? licen[cs]e
bsd | 2 | bsd license | (?:the )?bsd(?: style)? license
bsd | 2 | bsd licence | (?:the )?bsd(?: style)? licence
bsd | 2 | opensource bsd license | opensource org licenses? bsd license(?: php)?
bsd | 1 | bsd licensed | bsd licensed
apache-2 | 5 | spdx apache 2 | spdx license identifier apache 2 0
apache-2 | 5 | licensed apache license version except | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | 4 | irrevocable perpetual contributor | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2 | 4 | unless basis conditions | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2 | 3 | apache 2 | (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: public)?(?: licen[cs]e)?(?: version)?(?: v)? (?:2|2 0)
apache-2 | 3 | apache v2 | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache(?: licen[cs]e)? v2(?: 0)?(?: licen[cs]e)?
apache-2 | 2 | apache license version 2 | (?:the )?apache license version 2(?: 0)?
apache-2 | 2 | apache 2 | apache(?: software)? licen[cs]e 2(?: 0)?
apache-2 | 2 | apache 2 | apache 2(?: 0)? licen[cs]e
apache-2 | 2 | apache v2 | apache licen[cs]e v2(?: 0)?
apache-2 | 2 | apache licenses 2 | apache org licenses license 2 0(?: html| txt)?
apache-2 | 2 | opensource apache 2 | opensource org licenses? apache 2 0
apache-2 | 2 | asl 2 | asl 2 0
apache-1.1 | 5 | spdx apache 1 | spdx license identifier apache 1 1
apache-1.1 | 3 | apache 1 | apache(?: software)? license(?: version)? 1 1
apache-1.1 | 4 | apache foundation developed | this product includes software developed by the apache software foundation
apache-1.0 | 5 | spdx apache 1 | spdx license identifier apache 1 0
apache-1.0 | 3 | apache 1 | apache(?: software)? license(?: version)? 1 0
apache | 2 | apache license | (?:the )?apache(?: software)? license
apache | 2 | apache licence | (?:the )?apache(?: software)? licence
apache | 1 | apache licensed | apache licensed
gpl-3 | 5 | spdx gpl 3 | spdx license identifier gpl 3 0(?: only)?
gpl-3-or-later | 5 | spdx gpl 3 later | spdx license identifier gpl 3 0 or later
gpl-3-or-later | 5 | gnu general version 3 later | under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
gpl-3 | 4 | protecting users rights | protecting users legal rights from (?:[^ ]+ ){0,12}?tivoi[sz]ation
gpl-3 | 4 | copyleft kinds works | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3 | 3 | gnu general version 3 | (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e(?: gpl)? version 3(?: 0)?
gpl-3-or-later | 3 | gnu general 3 later | gnu general public licen[cs]e(?: gpl)? version 3(?: 0)? or(?: at your option)?(?: any)? later(?: version)?
gpl-3 | 3 | gpl | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl(?: version| v)? 3(?: 0)?
gpl-3 | 3 | gplv3 | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gplv3
gpl-3 | 2 | gnu general 3 | gnu general public licen[cs]e(?: gpl)?(?: version| v)? 3(?: 0)?
gpl-3 | 2 | gnu general v3 | gnu general public licen[cs]e(?: gpl)? v3(?: 0)?
gpl-3 | 2 | gpl 3 | gpl(?: version| v)? 3(?: 0)?
gpl-3 | 2 | gpl v3 | gpl v3
gpl-3 | 2 | gplv3 | gplv3
gpl-3 | 2 | gpl3 | gpl3
gpl-3 | 2 | gnu licenses gpl 3 | gnu org licenses gpl 3 0(?: html| txt)?
gpl-3-or-later | 2 | gpl 3 later | gpl 3 0 or later
gpl-2 | 5 | spdx gpl 2 | spdx license identifier gpl 2 0(?: only)?
gpl-2-or-later | 5 | spdx gpl 2 later | spdx license identifier gpl 2 0 or later
gpl-2-or-later | 5 | gnu general version 2 later | under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version
gpl-2 | 4 | gnu guarantee share change | the gnu general public license is intended to guarantee your freedom to share and change free software
gpl-2 | 4 | franklin boston | 51 franklin (?:street|st) fifth floor boston ma
gpl-2 | 3 | gnu general version 2 | (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e(?: gpl)? version 2(?: 0)?
gpl-2-or-later | 3 | gnu general 2 later | gnu general public licen[cs]e(?: gpl)? version 2(?: 0)? or(?: at your option)?(?: any)? later(?: version)?
gpl-2 | 3 | gpl | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl(?: version| v)? 2(?: 0)?
gpl-2 | 3 | gplv2 | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gplv2
gpl-2 | 2 | gnu general 2 | gnu general public licen[cs]e(?: gpl)?(?: version| v)? 2(?: 0)?
gpl-2 | 2 | gpl 2 | gpl(?: version| v)? 2(?: 0)?
gpl-2 | 2 | gpl v2 | gpl v2
gpl-2 | 2 | gplv2 | gplv2
gpl-2 | 2 | gpl2 | gpl2
gpl-2 | 2 | gnu licenses gpl 2 | gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-2-classpath | 4 | independent exception modules | as a special exception the copyright holders of this library give you permission to link this library with independent modules
gpl-2-classpath | 3 | classpath exception | (?:with (?:the )?)?classpath exception
gpl-1 | 5 | spdx gpl 1 | spdx license identifier gpl 1 0(?: only| or later)?
gpl-1 | 2 | gnu general 1 | gnu general public license version 1(?: 0)?
gpl | 4 | hope useful warranty | this program is distributed in the hope that it will be useful but without any warranty
gpl | 4 | gnu general received copy | you should have received a copy of the gnu general public licen[cs]e along with this (?:program|software|library|package|file)
gpl | 3 | gnu general | (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e
gpl | 3 | gpl | (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl
gpl | 2 | gnu general public | gnu general public licen[cs]e
gpl | 2 | gnu gpl | gnu gpl
gpl | 2 | gpl licensed | gpl licensed
gpl | 2 | gnu licenses gpl | gnu org licenses gpl(?: html| txt)?
gpl | 1 | general public | general public licen[cs]e
lgpl-3 | 5 | spdx lgpl 3 | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3 | 3 | gnu lesser 3 | gnu lesser general public licen[cs]e(?: lgpl)?(?: version| v)? 3(?: 0)?
lgpl-3 | 5 | gnu lesser version 3 | under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e
lgpl-3 | 2 | lgpl 3 | lgpl(?: version| v)? 3(?: 0)?
lgpl-3 | 2 | lgplv3 | lgplv3
lgpl-3 | 2 | gnu licenses lgpl 3 | gnu org licenses lgpl 3 0
lgpl-2.1 | 5 | spdx lgpl 2 1 | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 | 3 | gnu lesser 2 1 | gnu lesser general public licen[cs]e(?: lgpl)?(?: version| v)? 2 1
lgpl-2.1 | 5 | gnu lesser version 2 1 | under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e
lgpl-2.1 | 2 | lgpl 2 1 | lgpl(?: version| v)? 2 1
lgpl-2.1 | 2 | lgplv2 1 | lgplv2 1
lgpl-2 | 5 | spdx lgpl 2 0 | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2 | 3 | gnu library 2 | gnu library general public licen[cs]e(?: version| v)? 2(?: 0)?
lgpl | 3 | gnu lesser | (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?gnu lesser general public licen[cs]e
lgpl | 2 | gnu lesser general | gnu lesser general public licen[cs]e
lgpl | 2 | gnu library general | gnu library general public licen[cs]e
lgpl | 2 | gnu lgpl | gnu lgpl
lgpl | 2 | lgpl | (?:licen[cs]ed|released|distributed|available) under (?:the )?lgpl
agpl-3 | 5 | spdx agpl 3 | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 | 5 | gnu affero version 3 | under the terms of the gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e
agpl-3 | 4 | program remotely prominently | notwithstanding any other provision of this license if you modify the program your modified version must prominently offer all users interacting with it remotely
agpl-3 | 3 | gnu affero 3 | gnu affero general public licen[cs]e(?: agpl)?(?: version| v)? 3(?: 0)?
agpl-3 | 2 | agpl 3 | agpl(?: version| v)? 3(?: 0)?
agpl-3 | 2 | agplv3 | agplv3
agpl | 2 | affero general public | (?:gnu )?affero general public licen[cs]e
agpl | 2 | gnu agpl | gnu agpl
agpl | 1 | agpl | agpl
gfdl | 5 | spdx gfdl | spdx license identifier gfdl 1 [123](?: only| or later)?
gfdl | 4 | invariant cover texts | with no invariant sections no front cover texts and no back cover texts
gfdl | 3 | gnu free documentation | (?:under the (?:terms of the )?)?gnu free documentation licen[cs]e
gfdl | 2 | gnu fdl org | gnu org (?:licenses|copyleft) fdl(?: html)?
gfdl | 1 | gfdl | gfdl
mpl-2 | 5 | spdx mpl 2 | spdx license identifier mpl 2 0
mpl-2 | 5 | mozilla source subject | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-2 | 4 | obtain mpl | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2 | 3 | mozilla 2 | mozilla public licen[cs]e(?: mpl)?(?: version| v)? 2(?: 0)?
mpl-2 | 2 | mozilla mpl 2 | mozilla org (?:en us )?mpl 2 0
mpl-2 | 2 | mpl 2 | mpl(?: version| v)? 2(?: 0)?
mpl-1.1 | 5 | spdx mpl 1 | spdx license identifier mpl 1 1
mpl-1.1 | 5 | contents subject mozilla 1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1 | 3 | mozilla 1 | mozilla public license(?: mpl)?(?: version| v)? 1 1
mpl-1.0 | 3 | mozilla 1 | mozilla public license(?: mpl)?(?: version| v)? 1 0
mpl | 2 | mozilla public | mozilla public licen[cs]e
epl-2 | 5 | spdx epl 2 | spdx license identifier epl 2 0
epl-2 | 4 | accompanying eclipse materials | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version) 2 0
epl-2 | 3 | eclipse 2 | eclipse public license(?: epl)?(?: version| v)? 2(?: 0)?
epl-2 | 2 | eclipse epl legal | eclipse org legal epl (?:v20|2 0)
epl-1 | 5 | spdx epl 1 | spdx license identifier epl 1 0
epl-1 | 4 | accompanying eclipse materials | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version) 1 0
epl-1 | 3 | eclipse 1 | eclipse public license(?: epl)?(?: version| v)? 1(?: 0)?
epl | 2 | eclipse public | eclipse public license
edl-1 | 3 | eclipse distribution | eclipse distribution license(?: v| version)?(?: 1(?: 0)?)?
cddl-1 | 5 | spdx cddl | spdx license identifier cddl 1 [01]
cddl-1 | 3 | common development distribution | common development and distribution licen[cs]e(?: cddl)?(?: version| v)?(?: 1(?: [01])?)?
cddl-1 | 1 | cddl | cddl
cpl-1 | 5 | spdx cpl | spdx license identifier cpl 1 0
cpl-1 | 3 | common public license | common public license(?: version| v)?(?: 1(?: 0)?)?
artistic-2 | 5 | spdx artistic 2 | spdx license identifier artistic 2 0
artistic-2 | 3 | artistic 2 | artistic license(?: version| v)? 2(?: 0)?
artistic-1 | 5 | spdx artistic 1 | spdx license identifier artistic 1 0(?: perl)?
artistic-1 | 3 | perl itself terms | (?:under the same terms as|the same terms as) perl itself
artistic | 2 | artistic license | (?:the )?(?:perl )?artistic license
bsl-1 | 5 | spdx bsl 1 | spdx license identifier bsl 1 0
bsl-1 | 3 | boost software | (?:distributed under the )?boost software license(?: version| v)?(?: 1(?: 0)?)?
bsl-1 | 2 | boost license 1 | boost org license 1 0 txt
zlib | 5 | spdx zlib | spdx license identifier zlib
zlib | 4 | altered source plainly | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | 4 | origin misrepresented claim | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 2 | zlib | (?:the )?zlib(?: libpng)? licen[cs]e
libpng | 5 | spdx libpng | spdx license identifier libpng(?: 2 0)?
libpng | 2 | libpng license | (?:the )?libpng license
unlicense | 5 | spdx unlicense | spdx license identifier unlicense
unlicense | 4 | unencumbered released | this is free and unencumbered software released into the public domain
unlicense | 3 | unlicense | (?:under )?the unlicense
unlicense | 2 | unlicense | unlicense org
wtfpl | 5 | spdx wtfpl | spdx license identifier wtfpl
wtfpl | 3 | fuck want public | do what the fuck you want to public license
wtfpl | 1 | wtfpl | wtfpl
cc0 | 5 | spdx cc0 | spdx license identifier cc0 1 0
cc0 | 4 | copyright neighboring | (?:has waived|waive) all copyright and related or neighboring rights
cc0 | 3 | cc0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0 | 3 | creative commons zero | creative commons zero(?: v)?(?: 1 0)?
cc0 | 2 | creativecommons zero | creativecommons org publicdomain zero(?: 1 0)?
cc-by | 5 | spdx cc by | spdx license identifier cc by [1234] [05]
cc-by | 3 | creative commons attribution | creative commons attribution(?: licen[cs]e)?(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by | 2 | cc by | cc by(?: [1234] [05])?
cc-by | 2 | creativecommons licenses by | creativecommons org licenses by(?: [1234] [05])?
cc-by-sa | 5 | spdx cc by sa | spdx license identifier cc by sa [1234] [05]
cc-by-sa | 3 | creative commons attribution | creative commons attribution share ?alike(?: licen[cs]e)?(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-sa | 2 | cc by sa | cc by sa(?: [1234] [05])?
cc-by-sa | 2 | creativecommons licenses by sa | creativecommons org licenses by sa(?: [1234] [05])?
cc-by-nd | 5 | spdx cc by nd | spdx license identifier cc by nd [1234] [05]
cc-by-nd | 3 | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: licen[cs]e)?(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nd | 2 | cc by nd | cc by nd(?: [1234] [05])?
cc-by-nd | 2 | creativecommons licenses by nd | creativecommons org licenses by nd(?: [1234] [05])?
cc-by-nc | 5 | spdx cc by nc | spdx license identifier cc by nc [1234] [05]
cc-by-nc | 3 | creative commons attribution | creative commons attribution non ?commercial(?: licen[cs]e)?(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc | 3 | cc by nc | (?:licen[cs]ed|released|distributed|available) under (?:a )?cc by nc(?: [1234] [05])?
cc-by-nc | 2 | cc by nc | cc by nc(?: [1234] [05])?
cc-by-nc | 2 | creativecommons licenses by nc | creativecommons org licenses by nc(?: [1234] [05])?
cc-by-nc-sa | 5 | spdx cc by nc sa | spdx license identifier cc by nc sa [1234] [05]
cc-by-nc-sa | 3 | creative commons attribution | creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-sa | 3 | cc by nc sa | (?:licen[cs]ed|released|distributed|available) under (?:a )?cc by nc sa(?: [1234] [05])?
cc-by-nc-sa | 2 | cc by nc sa | cc by nc sa(?: [1234] [05])?
cc-by-nc-sa | 2 | creativecommons licenses by nc sa | creativecommons org licenses by nc sa(?: [1234] [05])?
cc-by-nc-nd | 5 | spdx cc by nc nd | spdx license identifier cc by nc nd [1234] [05]
cc-by-nc-nd | 3 | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: licen[cs]e)?(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-nd | 3 | cc by nc nd | (?:licen[cs]ed|released|distributed|available) under (?:a )?cc by nc nd(?: [1234] [05])?
cc-by-nc-nd | 2 | cc by nc nd | cc by nc nd(?: [1234] [05])?
cc-by-nc-nd | 2 | creativecommons licenses by nc nd | creativecommons org licenses by nc nd(?: [1234] [05])?
cc | 2 | creative commons license | creative commons license
cc | 2 | creative commons licence | creative commons licence
cc | 1 | creativecommons licenses | creativecommons org licenses
public-domain | 3 | dedicated domain | dedicated to the public domain
public-domain | 3 | placed domain | (?:has been |is )?placed in(?:to)? the public domain
public-domain | 3 | released domain | released (?:in)?to the public domain
public-domain | 2 | this public domain | this (?:work|file|code|software|document|image|text) is in the public domain
public-domain | 2 | creativecommons mark | creativecommons org publicdomain mark(?: 1 0)?
public-domain | 1 | public domain dedication | public domain dedication
psf-2 | 5 | spdx identifier 2 | spdx license identifier (?:psf|python) 2 0
psf-2 | 3 | python software foundation license | python software foundation license(?: agreement)?(?: version| v)?(?: 2)?
psf-2 | 3 | psf license | psf license(?: agreement)?(?: version 2)?
ruby | 5 | spdx ruby | spdx license identifier ruby
ruby | 3 | ruby terms | (?:under the )?same terms as ruby
ruby | 2 | ruby license | (?:the )?ruby license
php-3 | 5 | spdx php 3 | spdx license identifier php 3 0[01]?
php-3 | 3 | php license 3 | php license(?: version)? 3 0[01]?
php-3 | 4 | source subject php | this source file is subject to version 3 0[01]? of the php license
openssl | 5 | spdx openssl | spdx license identifier openssl
openssl | 4 | openssl toolkit developed | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | 2 | openssl license | openssl license
ofl-1.1 | 5 | spdx ofl 1 | spdx license identifier ofl 1 1(?: no rfn| rfn)?
ofl-1.1 | 3 | sil font license | sil open font license(?: version| v)?(?: 1 1)?
ofl-1.1 | 3 | sil font software | this font software is licensed under the sil open font license
ofl-1.1 | 2 | scripts sil ofl | scripts sil org ofl
eupl-1.2 | 5 | spdx eupl 1 | spdx license identifier eupl 1 2
eupl-1.2 | 3 | european union licence 2 | european union public licence(?: eupl)?(?: version| v)? 1 2
eupl-1.1 | 3 | european union licence | european union public licence(?: eupl)?(?: version| v)? 1 1
eupl | 2 | european union public licence | european union public licence
eupl | 1 | eupl | eupl
ms-pl | 5 | spdx ms pl | spdx license identifier ms pl
ms-pl | 3 | microsoft public license | microsoft public license(?: ms pl)?
ms-rl | 5 | spdx ms rl | spdx license identifier ms rl
ms-rl | 3 | microsoft reciprocal license | microsoft reciprocal license(?: ms rl)?
afl-3 | 5 | spdx afl 3 | spdx license identifier afl 3 0
afl-3 | 3 | academic free license | academic free license(?: version| v)?(?: 3(?: 0)?)?
osl-3 | 5 | spdx osl 3 | spdx license identifier osl 3 0
osl-3 | 3 | open software license 3 | open software license(?: version| v)? 3(?: 0)?
ecl-2 | 5 | spdx ecl 2 | spdx license identifier ecl 2 0
ecl-2 | 3 | educational community license | educational community license(?: version| v)?(?: 2(?: 0)?)?
ncsa | 5 | spdx ncsa | spdx license identifier ncsa
ncsa | 3 | illinois university license | university of illinois (?:ncsa )?open source license
ncsa | 3 | ncsa license | ncsa open source license
postgresql | 5 | spdx postgresql | spdx license identifier postgresql
postgresql | 2 | postgresql license | (?:the )?postgresql license
unicode | 5 | spdx unicode | spdx license identifier unicode (?:dfs 2016|3 0)
unicode | 3 | unicode license agreement | unicode license agreement
w3c | 5 | spdx w3c | spdx license identifier w3c(?: 19980720| 20150513)?
w3c | 3 | w3c software notice | w3c software(?: and document)? notice and license
vim | 5 | spdx vim | spdx license identifier vim
vim | 2 | vim license | (?:the )?vim license
ijg | 4 | independent jpeg work | this software is based in part on the work of the independent jpeg group
ftl | 5 | spdx ftl | spdx license identifier ftl
ftl | 3 | freetype license | (?:the )?freetype (?:project )?license
curl | 5 | spdx curl | spdx license identifier curl
tcl | 5 | spdx tcl | spdx license identifier tcl
blueoak-1 | 5 | spdx blueoak 1 | spdx license identifier blueoak 1 0 0
blueoak-1 | 3 | blue oak model | blue oak model license(?: version)?(?: 1 0 0)?
mulan-psl-2 | 5 | spdx mulanpsl 2 | spdx license identifier mulanpsl 2 0
mulan-psl-2 | 3 | mulan psl | mulan psl v2
cecill-2.1 | 5 | spdx cecill | spdx license identifier cecill 2 1
cecill | 2 | cecill | (?:licence |the )?cecill(?: license)?
upl-1 | 5 | spdx upl 1 | spdx license identifier upl 1 0
upl-1 | 3 | universal permissive license | universal permissive license(?: upl)?(?: version| v)?(?: 1 0)?
sspl-1 | 5 | spdx sspl 1 | spdx license identifier sspl 1 0
sspl-1 | 3 | server side license | server side public license(?: version| v)?(?: 1)?
busl-1.1 | 5 | spdx busl 1 | spdx license identifier busl 1 1
busl-1.1 | 3 | business source license | business source license(?: version| v)?(?: 1 1)?
elastic-2 | 5 | spdx elastic 2 | spdx license identifier elastic 2 0
elastic-2 | 3 | elastic license | elastic license(?: version| v)?(?: 2(?: 0)?)?
polyform-nc | 5 | spdx polyform noncommercial | spdx license identifier polyform noncommercial 1 0 0
polyform-nc | 3 | polyform noncommercial | polyform noncommercial license(?: 1 0 0)?
commons-clause | 3 | commons clause condition | commons clause license condition(?: v)?(?: 1 0)?
odbl-1 | 5 | spdx odbl 1 | spdx license identifier odbl 1 0
odbl-1 | 3 | open database license | open (?:data commons open )?database license(?: odbl)?(?: v)?(?: 1 0)?
odc-by-1 | 5 | spdx odc by 1 | spdx license identifier odc by 1 0
odc-by-1 | 3 | open commons attribution | open data commons attribution license(?: odc by)?
pddl-1 | 5 | spdx pddl 1 | spdx license identifier pddl 1 0
pddl-1 | 3 | open commons domain | open data commons public domain dedication and licen[cs]e
cdla-permissive | 5 | spdx cdla permissive | spdx license identifier cdla permissive [12] 0
cdla-permissive | 3 | community data license permissive | community data license agreement permissive
cdla-sharing | 5 | spdx cdla sharing | spdx license identifier cdla sharing 1 0
cdla-sharing | 3 | community data license sharing | community data license agreement sharing
ogl-uk | 3 | open government licence | open government licence(?: v)?(?: [123] 0)?
etalab-2 | 3 | etalab | (?:licence ouverte(?: open licence)? )?etalab(?: 2 0)?
openrail | 3 | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: license)?
llama-community | 3 | llama community license | llama (?:[234] )?(?:[123] )?community license(?: agreement)?
gutenberg | 4 | ebook anyone anywhere | this ebook is for the use of anyone anywhere (?:[^ ]+ ){0,25}?at no cost and with almost no restrictions whatsoever
gutenberg | 3 | gutenberg license | project gutenberg license
json | 4 | shall good evil | the software shall be used for good not evil
beerware | 4 | beer return | if we meet some day and you think this stuff is worth it you can buy me a beer in return
beerware | 2 | beerware | (?:beerware license|the beerware)
hpnd | 5 | spdx hpnd | spdx license identifier hpnd
hpnd | 4 | permission fee documentation | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that
proprietary | 4 | unauthorized strictly prohibited | unauthorized (?:copying|use|reproduction|distribution) of this (?:file|document|software|work) (?:[^ ]+ ){0,8}?strictly prohibited
proprietary | 3 | rights reserved | all rights reserved
proprietary | 3 | proprietary confidential | proprietary and confidential
proprietary | 3 | reproduced permission | no part of this (?:publication|book|document|work) may be reproduced (?:[^ ]+ ){0,30}?without (?:the )?(?:prior )?(?:written )?permission
proprietary | 3 | confidential of | (?:is|contains) the confidential (?:and proprietary )?(?:property|information) of
proprietary | 2 | agreement end user | end user licen[cs]e agreement
proprietary | 1 | eula | eula
freeware | 2 | freeware | (?:this (?:program|software) is )?freeware
shareware | 2 | shareware | (?:this (?:program|software) is )?shareware
non-commercial | 3 | non commercial only | for non commercial (?:use|purposes) only
non-commercial | 3 | noncommercial only | for noncommercial (?:use|purposes) only
non-commercial | 2 | personal only | for personal use only
research-only | 3 | research only | for (?:academic |non commercial )?research (?:use|purposes) only
notice-no-ai | 3 | artificial intelligence | may not be used (?:for|in|to) (?:the )?(?:purpose of )?(?:train|training) (?:of )?(?:any )?artificial intelligence
notice-no-ai | 3 | mining reserved | rights? (?:for|to) text and data mining (?:is|are) (?:expressly )?reserved
unknown | 1 | licensed under | licensed under(?: the)?(?: terms of)?
unknown | 1 | licenced under | licenced under(?: the)?(?: terms of)?
unknown | 1 | spdx | spdx license identifier
unknown | 1 | license see | see (?:the )?(?:accompanying |included )?license(?: file)?(?: txt| md)?
unknown | 1 | copying see | see (?:the )?(?:file )?copying(?: file)? for (?:details|copying conditions|license)
unknown | 1 | license terms conditions | license terms and conditions
"""
