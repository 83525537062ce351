"""Signature rules of the license scan, hand-written, in order: of equal priority and stretch, the earlier rule stays.

A rule is `label | kind | keywords | pattern`. Patterns are matched on a text's words, lower-cased and joined by single
spaces, and begin and end at words; any match holds all of the keywords, so that a text that lacks one need not be
searched. `<v>`, `<lic>` and `<under>` stand for the fragments below. Labels are the public short names of the licenses.
"""

from __future__ import annotations

FRAGMENTS = {
    "<v>": r"(?:version |ver |v ?)?",
    "<lic>": r"licen[cs]e",
    "<under>": r"(?:licen[cs]ed|released|distributed|redistributed|available|provided|published|covered|offered|shared) under (?:the )?(?:terms (?:and conditions )?of |conditions of )?(?:the |an? )?",
    "<tag>": r"spdx <lic> identifier ",
}

#: kind: (priority, confidence)
KINDS = {"tag": (6, 0.99), "text": (5, 0.95), "notice": (4, 0.9), "link": (3, 0.85), "name": (2, 0.6), "phrase": (1, 0.4)}

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

RULES = r"""
gpl-1.0 | tag | spdx | <tag>gpl 1 0(?: only| or later)?
gpl-2.0 | tag | spdx | <tag>gpl 2 0(?: only)?
gpl-2.0-or-later | tag | spdx | <tag>gpl 2 0 or later
gpl-3.0 | tag | spdx | <tag>gpl 3 0(?: only)?
gpl-3.0-or-later | tag | spdx | <tag>gpl 3 0 or later
lgpl-2.0 | tag | spdx | <tag>lgpl 2 0(?: only| or later)?
lgpl-2.1 | tag | spdx | <tag>lgpl 2 1(?: only)?
lgpl-2.1-or-later | tag | spdx | <tag>lgpl 2 1 or later
lgpl-3.0 | tag | spdx | <tag>lgpl 3 0(?: only)?
lgpl-3.0-or-later | tag | spdx | <tag>lgpl 3 0 or later
agpl-3.0 | tag | spdx | <tag>agpl 3 0(?: only)?
agpl-3.0-or-later | tag | spdx | <tag>agpl 3 0 or later
apache-2.0 | tag | spdx | <tag>apache 2 0
apache-1.1 | tag | spdx | <tag>apache 1 1
mit | tag | spdx | <tag>mit
mit-0 | tag | spdx | <tag>mit 0
bsd-2-clause | tag | spdx | <tag>bsd 2 clause
bsd-3-clause | tag | spdx | <tag>bsd 3 clause
bsd-4-clause | tag | spdx | <tag>bsd 4 clause
0bsd | tag | spdx | <tag>0bsd
isc | tag | spdx | <tag>isc
zlib | tag | spdx | <tag>zlib
mpl-1.1 | tag | spdx | <tag>mpl 1 1
mpl-2.0 | tag | spdx | <tag>mpl 2 0
epl-1.0 | tag | spdx | <tag>epl 1 0
epl-2.0 | tag | spdx | <tag>epl 2 0
eupl-1.2 | tag | spdx | <tag>eupl 1 2
cddl-1.0 | tag | spdx | <tag>cddl 1 0
bsl-1.0 | tag | spdx | <tag>bsl 1 0
unlicense | tag | spdx | <tag>unlicense
wtfpl | tag | spdx | <tag>wtfpl
cc0-1.0 | tag | spdx | <tag>cc0 1 0
cc-by-4.0 | tag | spdx | <tag>cc by 4 0
cc-by-sa-4.0 | tag | spdx | <tag>cc by sa 4 0
cc-by-nc-4.0 | tag | spdx | <tag>cc by nc 4 0
cc-by-nd-4.0 | tag | spdx | <tag>cc by nd 4 0
cc-by-nc-sa-4.0 | tag | spdx | <tag>cc by nc sa 4 0
cc-by-nc-nd-4.0 | tag | spdx | <tag>cc by nc nd 4 0
ofl-1.1 | tag | spdx | <tag>ofl 1 1
artistic-2.0 | tag | spdx | <tag>artistic 2 0
busl-1.1 | tag | spdx | <tag>busl 1 1
python-2.0 | tag | spdx | <tag>(?:python|psf) 2 0
postgresql | tag | spdx | <tag>postgresql
ncsa | tag | spdx | <tag>ncsa
mit | text | free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | text | above copyright notice and this permission | the above copyright notice and this permission notice (?:[^ ]+ ){0,4}shall be included in all copies or substantial portions
mit | text | without warranty of any kind | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit-0 | text | without restriction including | permission is hereby granted free of charge to any person obtaining a copy of this software (?:[^ ]+ ){0,12}to deal in the software without restriction including (?:[^ ]+ ){0,24}and to permit persons to whom the software is furnished to do so the software is provided
isc | text | permission to use copy modify and or distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
isc | text | permission to use copy modify and distribute | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
0bsd | text | with or without fee is hereby granted the software | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
bsd | text | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | text | or implied | redistributions in binary form must reproduce the above copyright notice (?:[^ ]+ ){0,20}provided with the distribution this software is provided by (?:[^ ]+ ){0,10}as is and any expressed? or implied
bsd-3-clause | text | endorse or promote | neither the names? of (?:[^ ]+ ){1,12}may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | text | endorse or promote | the names? of (?:[^ ]+ ){1,8}may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | text | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
zlib | text | held liable for any damages | in no event will the authors be held liable for any damages arising from the use of this software
zlib | text | origin of this software | the origin of this software must not be misrepresented you must not claim that you wrote the original software
apache-2.0 | text | under the apache | licensed under the apache <lic> <v>2 0 (?:the <lic> )?you may not use this file except in compliance with the <lic>
apache-2.0 | text | terms and conditions for use reproduction and distribution | apache <lic> version 2 0 january 2004(?: https? www apache org licenses)? terms and conditions for use reproduction and distribution
apache-2.0 | text | perpetual worldwide | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of
apache-1.1 | text | developed by the apache software foundation | this product includes software developed by the apache software foundation
gpl-2.0-or-later | text | version 2 of the | gnu general public <lic> as published by the free software foundation either version 2 of the <lic> or (?:at your option )?any later version
gpl-3.0-or-later | text | version 3 of the | gnu general public <lic> as published by the free software foundation either version 3 of the <lic> or (?:at your option )?any later version
gpl-2.0 | text | version 2 | gnu general public <lic> version 2 as published by the free software foundation
gpl-3.0 | text | version 3 | gnu general public <lic> version 3 as published by the free software foundation
gpl-2.0 | text | version 2 june 1991 | gnu general public <lic> version 2 june 1991
gpl-3.0 | text | version 3 29 june 2007 | gnu general public <lic> version 3 29 june 2007
gpl-1.0 | text | version 1 february 1989 | gnu general public <lic> version 1 february 1989
gpl | text | free software foundation | this program is free software you can redistribute it and or modify it under the terms of the gnu general public <lic> as published by the free software foundation
gpl | text | for more details | this program is distributed in the hope that it will be useful but without any warranty (?:[^ ]+ ){0,24}see the gnu general public <lic> for more details
gpl | text | received a copy | you should have received a copy of the gnu general public <lic>
lgpl-2.1 | text | version 2 1 february 1999 | gnu lesser general public <lic> version 2 1 february 1999
lgpl-2.0 | text | version 2 june 1991 | gnu library general public <lic> version 2 june 1991
lgpl-3.0 | text | version 3 29 june 2007 | gnu lesser general public <lic> version 3 29 june 2007
lgpl-2.1-or-later | text | version 2 1 of the | gnu lesser general public <lic> as published by the free software foundation either version 2 1 of the <lic> or (?:at your option )?any later version
lgpl-3.0-or-later | text | version 3 of the | gnu lesser general public <lic> as published by the free software foundation either version 3 of the <lic> or (?:at your option )?any later version
lgpl | text | received a copy | you should have received a copy of the gnu (?:lesser|library) general public <lic>
agpl-3.0 | text | version 3 19 november 2007 | gnu affero general public <lic> version 3 19 november 2007
agpl-3.0-or-later | text | version 3 of the | gnu affero general public <lic> as published by the free software foundation either version 3 of the <lic> or (?:at your option )?any later version
agpl | text | received a copy | you should have received a copy of the gnu affero general public <lic>
gfdl | text | free documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation <lic>
gfdl-1.3 | text | version 1 3 | gnu free documentation <lic> version 1 3
gfdl-1.2 | text | version 1 2 | gnu free documentation <lic> version 1 2
mpl-2.0 | text | mozilla public | this source code form is subject to the terms of the mozilla public <lic> <v>2 0
mpl-2.0 | text | mozilla org mpl 2 0 | if a copy of the mpl was not distributed with this file you can obtain one at https? (?:www )?mozilla org mpl 2 0
mpl-1.1 | text | mozilla public | the contents of this file are subject to the mozilla public <lic> version 1 1
mpl-1.0 | text | mozilla public | the contents of this file are subject to the mozilla public <lic> version 1 0
cddl-1.0 | text | common development and distribution | subject to the terms of the common development and distribution <lic>
epl-1.0 | text | eclipse public | made available under the terms of the eclipse public <lic> <v>1 0
epl-2.0 | text | eclipse public | made available under the terms of the eclipse public <lic> <v>2 0
unlicense | text | unencumbered | this is free and unencumbered software released into the public domain
cc0-1.0 | text | waived all copyright | (?:has|have) waived all copyright and related or neighbou?ring rights
wtfpl | text | what the fuck you want to | you just do what the fuck you want to
bsl-1.0 | text | boost | boost software <lic> version 1 0 august 17th 2003
ofl-1.1 | text | sil open font | sil open font <lic> version 1 1 26 february 2007
artistic-1.0 | text | artistic | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
beerware | text | buy me a beer | (?:we|and) (?:[^ ]+ ){0,8}you can buy me a beer in return
json | text | good not evil | the software shall be used for good not evil
public-domain | text | public domain | (?:this|the) (?:work|file|code|software|text|document|program|image|material) (?:is|was|has been)(?: hereby)? (?:placed |put |released |dedicated )?(?:in|into|to) the public domain
proprietary | text | proprietary and confidential | (?:this|the) (?:file|software|document|code|material|source code) (?:is|contains) (?:[^ ]+ ){0,6}proprietary and confidential
proprietary | text | unauthori | unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: or (?:copying|reproduction|use|distribution))? of this (?:file|document|work|material|software|publication)(?: via any medium)? is strictly prohibited
proprietary | text | written permission | no part of this (?:publication|book|work|document|site|website) may be reproduced (?:[^ ]+ ){0,40}without (?:the )?(?:express )?(?:prior )?(?:prior written permission|written permission)
gpl-3.0 | notice | general public | <under>(?:gnu )?general public <lic> <v>3(?: 0)?
gpl-3.0-or-later | notice | general public | <under>(?:gnu )?general public <lic> <v>3(?: 0)? or (?:any )?later
gpl-2.0 | notice | general public | <under>(?:gnu )?general public <lic> <v>2(?: 0)?
gpl-2.0-or-later | notice | general public | <under>(?:gnu )?general public <lic> <v>2(?: 0)? or (?:any )?later
gpl | notice | general public | <under>(?:gnu )?general public <lic>
gpl-3.0 | notice | gpl | <under>(?:gnu )?gpl ?<v>3(?: 0)?
gpl-2.0 | notice | gpl | <under>(?:gnu )?gpl ?<v>2(?: 0)?
gpl | notice | gpl | <under>(?:gnu )?gpl
lgpl-3.0 | notice | lesser general public | <under>(?:gnu )?lesser general public <lic> <v>3(?: 0)?
lgpl-2.1 | notice | lesser general public | <under>(?:gnu )?lesser general public <lic> <v>2 1
lgpl | notice | lesser general public | <under>(?:gnu )?lesser general public <lic>
lgpl | notice | lgpl | <under>(?:gnu )?lgpl(?: <v>[23](?: [01])?)?
agpl-3.0 | notice | affero | <under>(?:gnu )?affero general public <lic> <v>3(?: 0)?
agpl | notice | affero | <under>(?:gnu )?affero general public <lic>
agpl | notice | agpl | <under>(?:gnu )?agpl(?: ?<v>3(?: 0)?)?
gfdl | notice | documentation | <under>(?:gnu )?free documentation <lic>
apache-2.0 | notice | apache | <under>apache (?:software )?<lic> <v>2(?: 0)?
apache-2.0 | notice | apache | <under>apache <v>2(?: 0)?(?: <lic>)?
apache | notice | apache | <under>apache (?:software )?<lic>
mit | notice | mit | <under>mit(?: x11)? <lic>
mit | notice | mit | <under>mit
bsd-2-clause | notice | bsd | <under>(?:2 clause |two clause |simplified |freebsd )bsd(?: <lic>)?
bsd-2-clause | notice | bsd | <under>bsd 2 clause(?: simplified)?(?: <lic>)?
bsd-3-clause | notice | bsd | <under>(?:3 clause |three clause |new |revised |modified )bsd(?: <lic>)?
bsd-3-clause | notice | bsd | <under>bsd 3 clause(?: <lic>)?
bsd-4-clause | notice | bsd | <under>(?:original |4 clause |four clause )bsd(?: <lic>)?
bsd | notice | bsd | <under>bsd(?: style)?(?: <lic>)?
isc | notice | isc | <under>isc(?: <lic>)?
zlib | notice | zlib | <under>zlib(?: libpng)?(?: <lic>)?
mpl-2.0 | notice | mozilla | <under>mozilla public <lic> <v>2(?: 0)?
mpl | notice | mozilla | <under>mozilla public <lic>
mpl | notice | mpl | <under>mpl(?: ?<v>[12](?: [01])?)?
epl-2.0 | notice | eclipse | <under>eclipse public <lic> <v>2(?: 0)?
epl | notice | eclipse | <under>eclipse public <lic>
cddl | notice | common development | <under>common development and distribution <lic>
cpl-1.0 | notice | common public | <under>common public <lic>(?: <v>1 0)?
eupl | notice | european union public | <under>european union public licen[cs]e
eupl | notice | eupl | <under>eupl(?: ?<v>1 [12])?
bsl-1.0 | notice | boost | <under>boost software <lic>(?: <v>1 0)?
unlicense | notice | unlicense | <under>unlicense
wtfpl | notice | wtfpl | <under>wtfpl
artistic-2.0 | notice | artistic | <under>artistic <lic> <v>2(?: 0)?
artistic | notice | artistic | <under>artistic <lic>
perl | notice | same terms as perl | under the same terms as perl itself
python-2.0 | notice | python software foundation | <under>python software foundation <lic>(?: <v>2)?
php-3.01 | notice | php | <under>php <lic>(?: <v>3 01)?
ruby | notice | ruby | <under>ruby(?: s)? <lic>
ofl-1.1 | notice | open font | <under>(?:sil )?open font <lic>(?: <v>1 1)?
busl-1.1 | notice | business source | <under>business source <lic>(?: <v>1 1)?
sspl-1.0 | notice | server side public | <under>server side public <lic>(?: <v>1(?: 0)?)?
elastic-2.0 | notice | elastic | <under>elastic <lic>(?: <v>2(?: 0)?)?
polyform | notice | polyform | <under>polyform (?:noncommercial|small business|shield|perimeter|strict)(?: <lic>)?
openrail | notice | rail | <under>(?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: <lic>)?
odbl-1.0 | notice | database | <under>open (?:data commons )?(?:open )?database <lic>(?: <v>1 0)?
odc-by-1.0 | notice | open data commons | <under>open data commons attribution <lic>(?: <v>1 0)?
pddl-1.0 | notice | public domain dedication | <under>(?:open data commons )?public domain dedication and <lic>
ogl-uk | notice | open government | <under>open government <lic>(?: <v>[123](?: 0)?)?
ms-pl | notice | microsoft public | <under>microsoft public <lic>
ms-rl | notice | microsoft reciprocal | <under>microsoft reciprocal <lic>
upl-1.0 | notice | universal permissive | <under>universal permissive <lic>(?: <v>1 0)?
vim | notice | vim | <under>vim <lic>
afl-3.0 | notice | academic free | <under>academic free <lic>(?: <v>3 0)?
osl-3.0 | notice | open software | <under>open software <lic>(?: <v>3 0)?
lppl-1.3c | notice | latex project public | <under>latex project public <lic>(?: <v>1 3c?)?
openssl | notice | openssl | <under>openssl <lic>
ncsa | notice | ncsa | <under>(?:university of illinois )?ncsa(?: open source)? <lic>
postgresql | notice | postgresql | <under>postgresql <lic>
zpl-2.1 | notice | zope | <under>zope public <lic>(?: <v>2 1)?
ecl-2.0 | notice | educational community | <under>educational community <lic>(?: <v>2 0)?
mulan-2.0 | notice | mulan | <under>mulan (?:psl|permissive software <lic>)(?: <v>2)?
cc-by-4.0 | notice | cc by | <under>cc by 4 0
cc-by-3.0 | notice | cc by | <under>cc by 3 0
cc-by-sa-4.0 | notice | cc by | <under>cc by sa 4 0
cc-by-sa-3.0 | notice | cc by | <under>cc by sa 3 0
cc-by-nc-4.0 | notice | cc by | <under>cc by nc 4 0
cc-by-nc-3.0 | notice | cc by | <under>cc by nc 3 0
cc-by-nd-4.0 | notice | cc by | <under>cc by nd 4 0
cc-by-nc-sa-4.0 | notice | cc by | <under>cc by nc sa 4 0
cc-by-nc-sa-3.0 | notice | cc by | <under>cc by nc sa 3 0
cc-by-nc-nd-4.0 | notice | cc by | <under>cc by nc nd 4 0
cc-by-nc-nd-3.0 | notice | cc by | <under>cc by nc nd 3 0
cc-by | notice | creative commons | <under>creative commons attribution(?: <v>[1-4] [05])?(?: international| unported| generic)?(?: <lic>)?
cc-by-sa | notice | creative commons | <under>creative commons attribution share ?alike(?: <v>[1-4] [05])?(?: international| unported| generic)?(?: <lic>)?
cc-by-nc | notice | creative commons | <under>creative commons attribution non ?commercial(?: <v>[1-4] [05])?(?: international| unported| generic)?(?: <lic>)?
cc-by-nd | notice | creative commons | <under>creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: <v>[1-4] [05])?(?: international| unported| generic)?(?: <lic>)?
cc-by-nc-sa | notice | creative commons | <under>creative commons attribution non ?commercial share ?alike(?: <v>[1-4] [05])?(?: international| unported| generic)?(?: <lic>)?
cc-by-nc-nd | notice | creative commons | <under>creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: <v>[1-4] [05])?(?: international| unported| generic)?(?: <lic>)?
cc0-1.0 | notice | cc0 | <under>(?:creative commons )?cc0(?: 1 0)?(?: universal)?
apache-2.0 | link | apache org licenses | https? (?:www )?apache org licenses license 2 0
gpl | link | gnu org licenses | https? (?:www )?gnu org licenses gpl(?: [123] 0)?
lgpl | link | gnu org licenses | https? (?:www )?gnu org licenses lgpl(?: [23] [01])?
agpl | link | gnu org licenses | https? (?:www )?gnu org licenses agpl(?: 3 0)?
gfdl | link | gnu org licenses | https? (?:www )?gnu org licenses fdl(?: 1 [123])?
mit | link | opensource org licenses | https? (?:www )?opensource org licenses mit(?: <lic>)?
bsd | link | opensource org licenses | https? (?:www )?opensource org licenses bsd(?: [234] clause| <lic>)?
isc | link | opensource org licenses | https? (?:www )?opensource org licenses isc
mpl-2.0 | link | mozilla org mpl | https? (?:www )?mozilla org mpl 2 0
epl-2.0 | link | eclipse org legal | https? (?:www )?eclipse org legal epl (?:2 0|v20)
epl-1.0 | link | eclipse org legal | https? (?:www )?eclipse org legal epl v10
bsl-1.0 | link | boost org | https? (?:www )?boost org license 1 0
unlicense | link | unlicense org | https? (?:www )?unlicense org
cc-by-4.0 | link | creativecommons org licenses | https? (?:www )?creativecommons org licenses by 4 0
cc-by-3.0 | link | creativecommons org licenses | https? (?:www )?creativecommons org licenses by 3 0
cc-by-2.0 | link | creativecommons org licenses | https? (?:www )?creativecommons org licenses by 2 [05]
cc-by-sa-4.0 | link | creativecommons org licenses | https? (?:www )?creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | link | creativecommons org licenses | https? (?:www )?creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | link | creativecommons org licenses | https? (?:www )?creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | link | creativecommons org licenses | https? (?:www )?creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | link | creativecommons org licenses | https? (?:www )?creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | link | creativecommons org licenses | https? (?:www )?creativecommons org licenses by nc nd 4 0
cc0-1.0 | link | creativecommons org publicdomain | https? (?:www )?creativecommons org publicdomain zero 1 0
public-domain | link | creativecommons org publicdomain | https? (?:www )?creativecommons org publicdomain mark 1 0
ofl-1.1 | link | scripts sil org | https? scripts sil org ofl
odbl-1.0 | link | opendatacommons org | https? (?:www )?opendatacommons org licenses odbl
odc-by-1.0 | link | opendatacommons org | https? (?:www )?opendatacommons org licenses by
ogl-uk | link | nationalarchives gov uk | https? (?:www )?nationalarchives gov uk doc open government licence
gpl-3.0 | name | gplv3 | gplv3(?: \d)?
gpl-2.0 | name | gplv2 | gplv2(?: \d)?
gpl-3.0 | name | general public | (?:gnu )?general public <lic> <v>3(?: 0)?
gpl-2.0 | name | general public | (?:gnu )?general public <lic> <v>2(?: 0)?
gpl | name | general public | gnu general public <lic>
lgpl | name | lesser general public | (?:gnu )?lesser general public <lic>(?: <v>[23](?: [01])?)?
lgpl | name | library general public | (?:gnu )?library general public <lic>(?: <v>2(?: 0)?)?
agpl | name | affero | (?:gnu )?affero general public <lic>(?: <v>3(?: 0)?)?
agpl-3.0 | name | agplv3 | agplv3
lgpl-3.0 | name | lgplv3 | lgplv3
gfdl | name | free documentation | (?:gnu )?free documentation <lic>
apache-2.0 | name | apache | apache (?:software )?<lic> <v>2(?: 0)?
apache-2.0 | name | asl 2 | asl 2 0
apache | name | apache | apache (?:software )?<lic>
mit | name | mit lic | mit licen[cs]ed?
x11 | name | x11 | x11 <lic>
bsd-2-clause | name | bsd | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: <lic>)?
bsd-3-clause | name | bsd | (?:bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd)(?: <lic>)?
bsd | name | bsd | bsd licen[cs]ed?
isc | name | isc lic | isc <lic>
zlib | name | zlib | zlib(?: libpng)? <lic>
mpl-2.0 | name | mozilla | mozilla public <lic> <v>2(?: 0)?
mpl | name | mozilla | mozilla public <lic>
epl | name | eclipse | eclipse public <lic>(?: <v>[12](?: 0)?)?
cddl | name | common development | common development and distribution <lic>
cpl-1.0 | name | common public | common public <lic>(?: <v>1 0)?
eupl | name | european union public | european union public licen[cs]e(?: <v>1 [12])?
bsl-1.0 | name | boost | boost software <lic>(?: <v>1 0)?
unlicense | name | the unlicense | the unlicense
wtfpl | name | wtfpl | wtfpl
artistic-2.0 | name | artistic | artistic <lic> <v>2(?: 0)?
artistic | name | artistic | artistic <lic>
ofl-1.1 | name | open font | (?:sil )?open font <lic>
busl-1.1 | name | business source | business source <lic>
sspl-1.0 | name | server side public | server side public <lic>
odbl-1.0 | name | database | open database <lic>
ogl-uk | name | open government | open government <lic>
ms-pl | name | microsoft public | microsoft public <lic>
cc0-1.0 | name | cc0 | cc0(?: 1 0)?(?: universal)?
cc-by-nc-sa | name | cc by | cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | name | cc by | cc by nc nd(?: [1-4] [05])?
cc-by-nc | name | cc by | cc by nc(?: [1-4] [05])?
cc-by-nd | name | cc by | cc by nd(?: [1-4] [05])?
cc-by-sa | name | cc by | cc by sa(?: [1-4] [05])?
cc-by-4.0 | name | cc by | cc by 4 0
cc-by-3.0 | name | cc by | cc by 3 0
cc-by | name | creative commons | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: <lic>)?
cc-by-sa | name | creative commons | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: <lic>)?
cc-by-nc | name | creative commons | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: <lic>)?
cc | name | creative commons | creative commons <lic>
public-domain | name | public domain | (?:in|into) the public domain
reserved | name | all rights | all rights (?:are )?reserved
reserved | name | tous droits | tous droits réservés
reserved | name | alle rechte vorbehalten | alle rechte vorbehalten
reserved | name | todos los derechos reservados | todos los derechos reservados
some-reserved | name | some rights reserved | some rights reserved
copyleft | name | copyleft | copyleft <lic>
proprietary | name | proprietary lic | proprietary <lic>
no-redistribution | name | redistribut | (?:do not redistribute|not for redistribution|redistribution is (?:not permitted|prohibited|forbidden))
non-commercial | name | commercial use | (?:for )?non ?commercial use only
"""
