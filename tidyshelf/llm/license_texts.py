"""Whole licence texts and notices as templates of ``license_scan``.

Fixed values: the wording of the licences. ``[[ ]]`` marks what may be left out, ``<<a,b>>`` names of holders.
"""

_HOLDER = "[[copyright <<1,12>>]] [[all rights reserved]]"

MIT = f"""
[[the]] [[mit license]] [[mit]] {_HOLDER}
permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files the software to deal in the software without restriction including without limitation the
rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all
copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the
warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<1,6>> be
liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out
of or in connection with the software or the use or other dealings in the software
"""

_BSD_SOURCE = f"""
{_HOLDER}
redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met
[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the
following disclaimer
[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the
following disclaimer in the documentation and or other materials provided with the distribution
"""

_BSD_NAMES = """
[[3]] neither the name of <<1,10>> nor the names of [[its]] [[<<1,3>>]] contributors may be used to endorse or promote
products derived from this software without specific prior written permission
"""

_BSD_DISCLAIMER = """
this software is provided by <<1,8>> as is and any express or implied warranties including but not limited to the
implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<1,8>>
be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to
procurement of substitute goods or services loss of use data or profits or business interruption however caused and
on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in
any way out of the use of this software even if advised of the possibility of such damage
"""

BSD_2 = _BSD_SOURCE + _BSD_DISCLAIMER
BSD_3 = _BSD_SOURCE + _BSD_NAMES + _BSD_DISCLAIMER

ISC = f"""
{_HOLDER}
permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
provided that the above copyright notice and this permission notice appear in all copies
the software is provided as is and <<1,4>> disclaims all warranties with regard to this software including all
implied warranties of merchantability and fitness in no event shall <<1,4>> be liable for any special direct indirect
or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of
contract negligence or other tortious action arising out of or in connection with the use or performance of this
software
"""

APACHE_HEADER = f"""
{_HOLDER}
licensed under the apache license version 2 0 the license you may not use this file except in compliance with the
license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 [[html]] [[txt]]
unless required by applicable law or agreed to in writing software distributed under the license is distributed on an
as is basis without warranties or conditions of any kind either express or implied see the license for the specific
language governing permissions and limitations under the license
"""

MPL_HEADER = """
this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
distributed with this file you can obtain one at [[http]] [[https]] [[www]] mozilla org mpl 2 0
"""


def _gpl_notice(version: int) -> str:
    return f"""
this <<1,4>> is free software you can redistribute it and or modify it under the terms of the gnu general public license
as published by the free software foundation either version {version} of the license or at your option any later version
[[this <<1,4>> is distributed in the hope that it will be useful but without any warranty without even the implied
warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details]]
"""


#: (label, template, anchor): the anchor is a run of mandatory words.
TEXTS = (
    ("mit-text", MIT, "permission is hereby granted free of charge"),
    ("bsd-2-clause", BSD_2, "redistribution and use in source and binary forms"),
    ("bsd-3-clause", BSD_3, "redistribution and use in source and binary forms"),
    ("isc", ISC, "for any purpose with or without fee is hereby granted"),
    ("apache-2.0-header", APACHE_HEADER, "you may not use this file except in compliance"),
    ("mpl-2.0-header", MPL_HEADER, "subject to the terms of the mozilla public license"),
    ("gpl-2.0-notice", _gpl_notice(2), "free software you can redistribute it"),
    ("gpl-3.0-notice", _gpl_notice(3), "free software you can redistribute it"),
)
