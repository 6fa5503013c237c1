"""Export a dense softmax model as an ONNX graph (bytes), without the onnx package.

Graph: ``output = Softmax(MatMul(input, W) + B)`` with ``input`` float[N, d],
``W`` float[d, k], ``B`` float[k].  The protobuf messages are written field by
field (wire types 0 = varint, 2 = length-delimited); only the fields this
graph needs are emitted.
"""

from __future__ import annotations

import numpy as np

# ONNX protobuf field numbers and enums used below.
_FLOAT = 1            # TensorProto.DataType.FLOAT
_IR_VERSION = 7
_OPSET = 13


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while True:
        b = n & 0x7F
        n >>= 7
        if n:
            out.append(b | 0x80)
        else:
            out.append(b)
            return bytes(out)


def _key(field: int, wire: int) -> bytes:
    return _varint((field << 3) | wire)


def _int(field: int, n: int) -> bytes:
    return _key(field, 0) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _key(field, 2) + _varint(len(data)) + data


def _str(field: int, s: str) -> bytes:
    return _bytes(field, s.encode("utf-8"))


def _tensor(name: str, arr: np.ndarray) -> bytes:
    arr = np.ascontiguousarray(arr, dtype="<f4")
    msg = b"".join(_int(1, d) for d in arr.shape)
    return msg + _int(2, _FLOAT) + _str(8, name) + _bytes(9, arr.tobytes())


def _value_info(name: str, dims) -> bytes:
    shape = b"".join(_bytes(1, _str(2, d) if isinstance(d, str) else _int(1, d)) for d in dims)
    tensor_type = _int(1, _FLOAT) + _bytes(2, shape)
    return _str(1, name) + _bytes(2, _bytes(1, tensor_type))


def _node(op: str, inputs, outputs, name: str) -> bytes:
    return (b"".join(_str(1, i) for i in inputs) + b"".join(_str(2, o) for o in outputs)
            + _str(3, name) + _str(4, op))


def dense_to_onnx(weights, bias=None, input_name: str = "input",
                  output_name: str = "output") -> bytes:
    w = np.asarray(weights, dtype=np.float64)
    k, d = w.shape
    b = np.zeros(k) if bias is None else np.asarray(bias, dtype=np.float64)
    graph = b"".join([
        _bytes(1, _node("MatMul", [input_name, "W"], ["z"], "matmul")),
        _bytes(1, _node("Add", ["z", "B"], ["logits"], "add")),
        _bytes(1, _node("Softmax", ["logits"], [output_name], "softmax")),
        _str(2, "dense_softmax"),
        _bytes(5, _tensor("W", w.T)),
        _bytes(5, _tensor("B", b)),
        _bytes(11, _value_info(input_name, ["N", d])),
        _bytes(12, _value_info(output_name, ["N", k])),
    ])
    opset = _str(1, "") + _int(2, _OPSET)
    return _int(1, _IR_VERSION) + _str(2, "framescore") + _bytes(7, graph) + _bytes(8, opset)
