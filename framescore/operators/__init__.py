from framescore.operators.evaluate import accuracy, accuracy_of, align
from framescore.operators.limits import first_n
from framescore.operators.models import (DenseSoftmax, LstmSoftmax, OnnxFileModel, OnnxModel,
                                         byte_weights, fit_centroids, ship_model_file, softmax)
from framescore.operators.offsets import assign_offsets
from framescore.operators.onnx_export import dense_to_onnx
from framescore.operators.rejects import split_rejects, tag_rejects
from framescore.operators.scoring import score, score_column

__all__ = [
    "accuracy", "accuracy_of", "align", "first_n", "DenseSoftmax", "LstmSoftmax",
    "OnnxFileModel", "OnnxModel", "byte_weights", "fit_centroids", "ship_model_file",
    "softmax", "assign_offsets", "dense_to_onnx", "split_rejects", "tag_rejects", "score",
    "score_column",
]
